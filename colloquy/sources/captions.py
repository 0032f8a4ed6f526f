"""Captions: utterances wrapped into lines, lines into cues, and cues in a sequence without overlap."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import words
from .formats import subtitles


@dataclass(frozen=True)
class Layout:
    lines: int = 2
    characters: int = 42
    least_ms: int = 1000
    most_ms: int = 7000


def wrapped(text: Column, characters: int) -> Column:
    """The words of a text in lines of at most ``characters``; a longer word has a line by itself. None for a blank text."""

    def put(lines: Column, word: Column) -> Column:
        last = F.substring_index(lines, "\n", -1)
        fits = F.length(last) + 1 + F.length(word) <= characters
        return F.when(lines == "", word).when(fits, F.concat(lines, F.lit(" "), word)).otherwise(F.concat(lines, F.lit("\n"), word))

    joined = F.aggregate(words(text), F.lit(""), put)
    return F.when(joined == "", F.array().cast("array<string>")).otherwise(F.split(joined, "\n"))


def caption_drafts(utterances: DataFrame, key: str, layout: Layout = Layout()) -> DataFrame:
    """(key, ``idx, nth, speaker, start, end, text``): the parts of each utterance, which share its time by their numbers of characters."""
    lines = wrapped(F.col("text"), layout.characters)
    each = utterances.select(key, "idx", "speaker", "start_ms", "end_ms", lines.alias("lines")).filter(F.size("lines") > 0)
    count = F.ceil(F.size("lines") / layout.lines).cast("int")
    chunks = F.transform(F.sequence(F.lit(0), count - 1), lambda k: F.slice("lines", k * layout.lines + 1, F.lit(layout.lines)))
    chunked = each.withColumn("chunks", chunks).withColumn("weights", F.transform("chunks", lambda c: F.greatest(F.aggregate(c, F.lit(0), lambda s, x: s + F.length(x)), F.lit(1))))
    upto = lambda n: F.aggregate(F.slice("weights", F.lit(1), n), F.lit(0), lambda s, w: s + w)
    rows = chunked.select("*", upto(F.size("weights")).alias("total"), F.posexplode("chunks").alias("nth", "chunk"))
    at = lambda w: F.col("start_ms") + (F.col("end_ms") - F.col("start_ms")) * w / F.col("total")
    start, end = at(upto(F.col("nth"))), at(upto(F.col("nth") + 1))
    return rows.select(key, "idx", "nth", "speaker", start.alias("start"), F.greatest(start, end).alias("end"), F.array_join("chunk", "\n").alias("text"))


def caption_cues(utterances: DataFrame, key: str = "meeting_id", layout: Layout = Layout()) -> DataFrame:
    """(key, ``cue, speaker, start_ms, end_ms, text``): cues in order of time, numbered from 1.

    A cue starts no earlier than the one before it ends, is shown for the least and at most the longest duration, and ends when the next one begins unless that
    would make it too short. Blank utterances give none. A meeting's cues are folded in one expression.
    """
    draft = F.struct("start", "end", "idx", "nth", "speaker", "text")
    held = caption_drafts(utterances, key, layout).groupBy(key).agg(F.array_sort(F.collect_list(draft)).alias("d"))
    ahead = F.transform("d", lambda x, k: F.struct(x["start"].alias("start"), x["end"].alias("end"), x.speaker.alias("speaker"), x.text.alias("text"), F.get("d", k + 1)["start"].alias("following")))
    none = F.array().cast("array<struct<start:double,end:double,speaker:string,text:string>>")

    def follow(state: Column, x: Column) -> Column:
        start = F.greatest(x["start"], state.cursor)
        end = F.least(F.greatest(x["end"], start + layout.least_ms), start + layout.most_ms)
        end = F.when(x.following.isNull(), end).otherwise(F.least(end, F.greatest(x.following, start + layout.least_ms)))
        return F.struct(end.alias("cursor"), F.array_append(state.cues, F.struct(start.alias("start"), end.alias("end"), x.speaker.alias("speaker"), x.text.alias("text"))).alias("cues"))

    placed = held.select(key, F.aggregate(ahead, F.struct(F.lit(0.0).alias("cursor"), none.alias("cues")), follow).cues.alias("cues"))
    each = placed.select(key, F.posexplode("cues").alias("n", "c"))
    ms = lambda c: F.round(c).cast("long")
    return each.select(key, (F.col("n") + 1).alias("cue"), "c.speaker", ms(F.col("c.start")).alias("start_ms"), ms(F.col("c.end")).alias("end_ms"), "c.text")


def caption_documents(utterances: DataFrame, key: str = "meeting_id", style: str = "vtt", layout: Layout = Layout()) -> DataFrame:
    """(key, ``document``): WebVTT or SubRip of ``caption_cues``."""
    return subtitles(caption_cues(utterances, key, layout).withColumnRenamed("cue", "idx"), key, style)
