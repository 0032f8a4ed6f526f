"""DuckDB SQL of the queries about errors by kind of word."""

from __future__ import annotations

from .functions import words
from .oracles import basic_sql
from .plans.inputs import UTTERANCES_SQL


def listed(of: list[str]) -> str:
    return "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in of) + ")"


FILLERS, NUMBERS, ENGLISH, FRENCH, ENGLISH_ONLY, FRENCH_ONLY = map(listed, (words.FILLERS, words.NUMBER_WORDS, words.ENGLISH_FUNCTION_WORDS, words.FRENCH_FUNCTION_WORDS, words.ENGLISH_ONLY_WORDS, words.FRENCH_ONLY_WORDS))
LETTER = r"[\p{L}\p{Nl}\p{No}]"

#: Of twenty words of the hypothesis the eighth is dropped and the fifteenth replaced; the first is followed by one more.
DECOMPOSITION = rf"""WITH {UTTERANCES_SQL}, raw AS (SELECT meeting_id, idx, CASE WHEN idx % 2 = 0 THEN 'en' ELSE 'fr' END AS language, concat(text, CASE idx % 3
   WHEN 0 THEN ' Then Marie Curie said: Voila euh les Bruxelles' WHEN 1 THEN ' the douze Curie. Nantes and Nantes? is 42 the' ELSE ' nous avec Zoé Élan' END) AS raw FROM utterances),
 found AS (SELECT *, unnest(regexp_extract_all(regexp_replace(raw, '([.!?…:;]\s+|\n\s*|^\s*)', '\1' || chr(1), 'g'), chr(1) || '?(?:{LETTER}+(?:[''’-]{LETTER}+)*|\p{{Nd}}+(?:[.,]\p{{Nd}}+)*)')) AS t FROM raw),
 cap AS (SELECT meeting_id, idx, strip_accents(lower(ltrim(t, chr(1)))) AS name, regexp_matches(ltrim(t, chr(1)), '^\p{{Lu}}') AS up, t[1] = chr(1) AS starts FROM found),
 names AS (SELECT meeting_id, idx, name FROM cap GROUP BY ALL HAVING bool_or(up AND NOT starts) AND bool_and(up) AND len(name) >= 2 AND string_split(name, '''')[1] <> 'i'
   AND name NOT IN {FILLERS} AND name NOT IN {ENGLISH} AND name NOT IN {FRENCH}),
 w AS (SELECT meeting_id, idx, language, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS i FROM (SELECT *, list_filter(string_split({basic_sql('raw')}, ' '), lambda x: x <> '') AS ws FROM raw)),
 f AS (SELECT *, strip_accents(lower(word)) AS folded FROM w),
 c AS (SELECT f.*, CASE WHEN n.name IS NOT NULL OR folded = 'bruxelles' THEN 'proper_noun' WHEN regexp_matches(word, '\p{{Nd}}') OR folded IN {NUMBERS} THEN 'number' WHEN folded IN {FILLERS} THEN 'filler'
   WHEN language = 'fr' AND folded IN {ENGLISH_ONLY} OR language <> 'fr' AND folded IN {FRENCH_ONLY} THEN 'code_switched'
   WHEN language = 'fr' AND folded IN {FRENCH} OR language <> 'fr' AND folded IN {ENGLISH} THEN 'function_word' ELSE 'content_word' END AS category
   FROM f LEFT JOIN names n ON n.meeting_id = f.meeting_id AND n.idx = f.idx AND n.name = folded)
SELECT language, category, count(*) AS reference_words, count(*) FILTER (i % 20 NOT IN (7, 14)) AS hits, count(*) FILTER (i % 20 = 14) AS substitutions, count(*) FILTER (i % 20 = 7) AS deletions,
  round(count(*) FILTER (i % 20 IN (7, 14)) / count(*), 6) AS error_rate, round(count(*) FILTER (i % 20 NOT IN (7, 14)) / count(*), 6) AS recall FROM c GROUP BY ALL"""

#: Single linkage as what one can reach over pairs of centroids that are alike.
CLUSTERS = r"""WITH RECURSIVE x AS (SELECT vec_id // 100 AS meeting_id, label, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS dim FROM embeddings),
 c AS (SELECT meeting_id, label, list(v ORDER BY dim) AS v FROM (SELECT meeting_id, label, dim, avg(CAST(v AS DOUBLE)) AS v FROM x GROUP BY ALL) GROUP BY ALL),
 p AS (SELECT a.meeting_id, a.label AS a, b.label AS b FROM c a JOIN c b ON a.meeting_id = b.meeting_id WHERE a.label = b.label OR list_cosine_similarity(a.v, b.v) >= 0.12),
 r AS (SELECT meeting_id, a AS label, a AS b FROM p WHERE a = b UNION SELECT r.meeting_id, r.label, p.b FROM r JOIN p ON p.meeting_id = r.meeting_id AND p.a = r.b)
SELECT meeting_id, label, min(b) AS cluster FROM r GROUP BY ALL"""

_DAY = "CAST(d AS DATE)"


def _weekday(k: int) -> str:
    return f"{_DAY} + CAST((({k} - (isodow(d) - 1)) % 7 + 7 + 6) % 7 + 1 AS INTEGER)"


def _past(date: str, later: str) -> str:
    return f"CASE WHEN {date} >= {_DAY} THEN {date} ELSE {later} END"


_NEXT_MONTH = "date_trunc('month', d) + INTERVAL 1 MONTH"
#: Phrases and the date that each means.
MEANT = {
    "let us finish by Friday": _weekday(4), "on sunday please": _weekday(6), "pour lundi": _weekday(0), "next monday": f"{_DAY} + CAST(8 - isodow(d) AS INTEGER)", "jeudi prochain": f"{_DAY} + CAST(11 - isodow(d) AS INTEGER)",
    "Tomorrow, not friday": f"{_DAY} + 1", "the day after tomorrow": f"{_DAY} + 2", "d’ici après-demain": f"{_DAY} + 2", "demain": f"{_DAY} + 1", "by end of day": _DAY, "ce soir": _DAY, "2031-02-28 at noon": "DATE '2031-02-28'", "2031-02-30": "NULL",
    "March 3rd, 2028": "DATE '2028-03-03'", "le 3 mars 2028": "DATE '2028-03-03'", "the 7th of Sept": _past("make_date(year(d), 9, 7)", "make_date(year(d) + 1, 9, 7)"), "le 1er août": _past("make_date(year(d), 8, 1)", "make_date(year(d) + 1, 8, 1)"),
    "15/02 or so": _past("make_date(year(d), 2, 15)", "make_date(year(d) + 1, 2, 15)"), "01/02/97": "DATE '2097-02-01'", "by the 15th": _past("make_date(year(d), month(d), 15)", f"CAST({_NEXT_MONTH} + INTERVAL 14 DAY AS DATE)"),
    "avant le 2": _past("make_date(year(d), month(d), 2)", f"CAST({_NEXT_MONTH} + INTERVAL 1 DAY AS DATE)"), "next month": f"last_day({_NEXT_MONTH})", "EOM": "last_day(d)", "fin du mois": "last_day(d)", "in 2 months": "last_day(date_trunc('month', d) + INTERVAL 2 MONTH)",
    "dans 10 jours": f"{_DAY} + 10", "in 3 weeks": f"{_DAY} + 21", "end of the week": f"{_DAY} + CAST((12 - isodow(d)) % 7 AS INTEGER)", "la semaine prochaine": f"{_DAY} + CAST((12 - isodow(d)) % 7 + 7 AS INTEGER)", "le 14 h": "NULL", "soon, May 40": "NULL", "someday": "NULL",
}
PHRASES = list(MEANT)
DUE_PHRASES = "SELECT CAST(d AS VARCHAR) AS day, phrase, CAST(CASE phrase " + " ".join("WHEN '" + p.replace("'", "''") + f"' THEN CAST({m} AS DATE)" for p, m in MEANT.items()) + " END AS VARCHAR) AS due FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders), (SELECT unnest([" + ", ".join("'" + p.replace("'", "''") + "'" for p in PHRASES) + "]) AS phrase)"

#: What utterances are said with, so that evidence of every kind and none of it occurs.
LANGUAGE_CUES = ["Well, I don't think that they'll agree, which is nothing", "Mais nous avons déjà trouvé l'idée, d'accord", "zeta", "C'est gentiment noté", "merci", "They're morning things, qui sont bonnes"]


def _count(pattern: str) -> str:
    return f"len(regexp_extract_all(lower(x), '{pattern.replace(chr(39), chr(39) * 2)}'))"


_SCORES = rf"""sc AS (SELECT *, round(len(list_filter(t, lambda w: w IN {FRENCH_ONLY})) + 0.9 * {_count("(?:^|[^a-zà-ÿœ0-9_])(?:l|d|j|n|m|t|s|c|qu)['’][a-zà-öø-ÿ]")} + 0.7 * least({_count('[àâäçéèêëîïôöùûüÿœæ]')}, 4)
   + 0.4 * len(list_filter(t, lambda w: len(w) > 4 AND regexp_matches(w, '(?:ement|aient|eront|erons|ite)$'))), 9) AS f,
  round(len(list_filter(t, lambda w: w IN {ENGLISH_ONLY})) + 0.9 * {_count("(?:can|don|won|isn|aren|wasn|weren|didn|doesn|couldn|shouldn|wouldn|haven|hasn|hadn)['’]t|[a-zà-ÿœ0-9_]+['’](?:ll|re|ve|s|d|m)(?:[^a-zà-ÿœ0-9_]|$)")}
   + 0.25 * least({_count('(?:^|[^a-zà-ÿœ0-9_])th[a-zà-ÿœ0-9_]')}, 6) + 0.4 * len(list_filter(t, lambda w: len(w) > 4 AND regexp_matches(w, '(?:ing|ness)$'))), 9) AS e
  FROM (SELECT *, regexp_extract_all(strip_accents(lower(x)), '\p{{L}}+') AS t FROM said)),
 ve AS (SELECT *, (f + e >= 1.5 OR len(t) <= 3 AND (f >= 0.9 AND e = 0 OR e >= 0.9 AND f = 0)) AND abs(f - e) >= 0.6 AND abs(f - e) / greatest(f + e, 1e-9) >= 0.18 AS decided FROM sc),
 vl AS (SELECT *, CASE WHEN decided THEN CASE WHEN f > e THEN 'fr' ELSE 'en' END END AS language, CASE WHEN decided THEN abs(f - e) / (f + e) ELSE 0 END AS confidence FROM ve)"""
_CUES = ", ".join("'" + c.replace("'", "''") + "'" for c in LANGUAGE_CUES)
UTTERANCE_TAGS = rf"""WITH {UTTERANCES_SQL}, said AS (SELECT meeting_id, idx, speaker, trim([{_CUES}][(idx * 7 + meeting_id) % 6 + 1] || CASE WHEN idx % 3 = 0 THEN ' ' || text ELSE '' END) AS x FROM utterances), {_SCORES},
 mo AS (SELECT meeting_id, arg_min(language, ROW(-c, language)) AS most FROM (SELECT meeting_id, language, count(*) AS c FROM vl WHERE language IS NOT NULL GROUP BY ALL) GROUP BY meeting_id),
 nr AS (SELECT a.meeting_id, a.idx, arg_min(b.language, ROW(abs(b.idx - a.idx), b.idx < a.idx)) FILTER (b.speaker = a.speaker) AS own, arg_min(b.language, ROW(abs(b.idx - a.idx), b.idx > a.idx)) AS anyone
   FROM vl a JOIN vl b ON a.meeting_id = b.meeting_id AND b.language IS NOT NULL GROUP BY ALL)
SELECT vl.meeting_id, vl.idx, language, round(confidence, 6) AS confidence, round(f, 6) AS french, round(e, 6) AS english, coalesce(language, own, anyone, most) AS tag
FROM vl LEFT JOIN nr USING (meeting_id, idx) LEFT JOIN mo USING (meeting_id)"""

#: One cue for each way in which an action finds its owner.
OWNER_CUES = ["@assistant finish the budget report", "I will write the budget report", "Assistant, the numbers look odd", "User will check the release date", "Could you send the figures to the user", "Yes, exactly right.", "Nothing to add here", "Someone said please look at it"]


def _follows(passes: str, other: bool) -> str:
    """The speaker of the first of two units ahead that passes, within 45 s."""
    out = "NULL"
    for k in (2, 1):
        skip = f"WHEN s{k} = speaker THEN {out} " if other else ""
        out = f"CASE WHEN c{k} IS NULL THEN NULL {skip}WHEN t{k} - end_ms > 45000 THEN NULL WHEN c{k} IN ({passes}) THEN s{k} ELSE {out} END"
    return out


OWNERS = rf"""WITH {UTTERANCES_SQL}, w AS (SELECT meeting_id, list(DISTINCT speaker) AS people FROM utterances GROUP BY meeting_id),
 x AS (SELECT u.*, people, idx % 8 AS c, {', '.join(f"lead(idx % 8, {k}) OVER o AS c{k}, lead(speaker, {k}) OVER o AS s{k}, lead(start_ms, {k}) OVER o AS t{k}" for k in (1, 2))} FROM utterances u JOIN w USING (meeting_id) WINDOW o AS (PARTITION BY u.meeting_id ORDER BY idx)),
 r AS (SELECT *, list_contains(people, 'assistant') AS a, list_contains(people, 'user') AS b, CASE WHEN len(people) = 2 THEN list_filter(people, lambda p: p <> speaker)[1] END AS sole, {_follows('1, 5', True)} AS reply, {_follows('1', False)} AS committed FROM x),
 o AS (SELECT *, CASE WHEN c = 0 AND a THEN 'mention' WHEN c = 1 THEN 'first_person' WHEN c = 2 AND a AND speaker <> 'assistant' THEN 'vocative' WHEN c = 3 AND b THEN 'third_person' WHEN c = 4 AND b AND speaker <> 'user' THEN 'named'
   WHEN c IN (4, 7) AND sole IS NOT NULL THEN 'sole_counterpart' WHEN c IN (4, 7) AND reply IS NOT NULL THEN 'reply' WHEN committed IS NOT NULL THEN 'commitment' ELSE 'unassigned' END AS owner_source FROM r)
SELECT meeting_id, idx AS unit, owner_source, CASE owner_source WHEN 'mention' THEN 'assistant' WHEN 'first_person' THEN speaker WHEN 'vocative' THEN 'assistant' WHEN 'third_person' THEN 'user' WHEN 'named' THEN 'user' WHEN 'sole_counterpart' THEN sole WHEN 'reply' THEN reply WHEN 'commitment' THEN committed END AS owner FROM o"""
