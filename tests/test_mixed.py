"""Evidence of French and English, tags of utterances, and mixed texts."""

from pyspark.sql import functions as F

from colloquy.operators.mixed import identify, normalise_mixed, tag_utterances


def test_identify(spark):
    want = {
        "We think that they will take it": "en", "Nous avons déjà fait la réunion": "fr", "merci": "fr", "zeta": None, "": None, None: None, "on": None,
        "j'ai l'idée": "fr", "I don't": "en", "nous we": None, "hello bonjour the le": None, "Thanks": "en", "gentiment 2024": None,
    }
    df = spark.createDataFrame(list(enumerate(want)), "i int, t string")
    got = {r.t: (r.v.language, r.v.confidence) for r in df.select("t", identify(F.col("t")).alias("v")).collect()}
    assert {t: v[0] for t, v in got.items()} == want
    assert all((c > 0) == (x is not None) for x, c in got.values())


def test_tags_are_smoothed_and_revised(spark):
    said = [("A", "We think that they will take this"), ("B", "zeta"), ("A", "zeta"), ("B", "Nous avons déjà la réunion avec elles"), ("A", "merci bien"), ("A", "You would not want that, which they know"), ("C", "zeta")]
    df = spark.createDataFrame([(1, i, s, t, "fr" if s == "C" else None) for i, (s, t) in enumerate(said)], "meeting_id int, idx int, speaker string, text string, language string")
    tags = lambda **how: [r.tag for r in tag_utterances(df, **how).orderBy("idx").collect()]
    assert tags() == ["en", "fr", "fr", "fr", "fr", "en", "en"]
    assert tags(revise=True) == ["en", "fr", "en", "fr", "en", "en", "en"]  # weak French between strong English of one speaker
    assert tags(engine_tags=True)[-1] == "fr"
    nothing = df.withColumn("text", F.lit("zeta"))
    assert {r.tag for r in tag_utterances(nothing).collect()} == {None} and {r.tag for r in tag_utterances(nothing, default="fr").collect()} == {"fr"}


def test_mixed_texts(spark):
    texts = ["Nous avons 25 % ! We don't have twenty five.", "zeta. Nous avons la réunion, n° 3. Okay.", "x 5", None, "  ", "We're here. They aren't. Merci beaucoup, c'est très bien."]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    got = {r.k: r.normalized for r in normalise_mixed(df, ["k"]).collect()}
    assert got == {
        0: "nous avons vingt cinq pour cent we do not have 25", 1: "zeta nous avons la réunion numéro trois ok", 2: "x 5", 3: None, 4: "", 5: "we are here they are not merci beaucoup c est très bien",
    }
    assert normalise_mixed(df.limit(0), ["k"]).count() == 0
