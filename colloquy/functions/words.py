"""Word lists that several operators share, without accents and in lower case."""

from __future__ import annotations

#: Words that mark French and English speech.
FRENCH_FUNCTION_WORDS = """
je tu il elle nous vous ils elles on le la les un une des du au aux ce cet cette ces mon ton notre votre leur mes tes ses nos vos leurs et ou mais donc ni que qui quoi dont
ainsi alors aussi avec sans sous dans chez vers pour par pas plus moins tres trop bien beaucoup peu encore deja toujours jamais rien tout tous toute toutes meme autre autres
faire fait faut etre est sont etait sera avoir avons avez ont avait peut peux pouvez veux veut voulez dois doit devez vais allez voila voici oui non merci bonjour bonsoir
salut reunion prochaine semaine jour demain hier matin soir parce puisque lorsque pendant depuis apres avant entre comme quand comment pourquoi combien quel quelle quels
quelles cela ceci celui celle ceux notamment surtout plutot vraiment effectivement d'accord peut-etre est-ce qu'est-ce ok okay lundi mardi mercredi jeudi vendredi samedi
dimanche janvier fevrier mars avril juin juillet septembre octobre novembre decembre""".split()
ENGLISH_FUNCTION_WORDS = """
i you he she we they it me him her us them my your his our their its the an this that these those and or but so because if then than though although while whereas with
without within into onto from about over under between during before after since until of to for at on in by not no yes yeah just very really quite still already always never
nothing everything something anything all every each both other another is are was were be been being am have has had do does did can could will would shall should may might
must going get got make made take took think know need want let ok okay thanks thank hello hi meeting week tomorrow yesterday morning evening today what when where which who
whose why how monday tuesday wednesday thursday friday saturday sunday january february april june july september october november december sure right agreed yep fine exactly
absolutely""".split()
FRENCH_ONLY_WORDS = [w for w in FRENCH_FUNCTION_WORDS if w not in ENGLISH_FUNCTION_WORDS]
ENGLISH_ONLY_WORDS = [w for w in ENGLISH_FUNCTION_WORDS if w not in FRENCH_FUNCTION_WORDS]

#: Words of hesitation, and number words of both languages.
FILLERS = "euh euhm heu hein ben bah hum hm hmm mmh mm mhm uh um erm ah oh bon voila quoi".split()
NUMBER_WORDS = """
zero un une deux trois quatre cinq six sept huit neuf dix onze douze treize quatorze quinze seize vingt trente quarante cinquante soixante cent cents mille million millions
milliard milliards one two three four five seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty
seventy eighty ninety hundred thousand billion""".split()
