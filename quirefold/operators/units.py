"""Passages, sentences and reading units."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quirefold.functions.sentences import sentences
from quirefold.functions.text import FULL_TEXT_KINDS, context_hash, context_key, count_words, half_up
from quirefold.session import cut

MOST_WORDS = 32
STRETCH = 1024  # characters of a passage that segments and units are met in


def passages(blocks: DataFrame, keys: list[str], order: str = "blockno") -> DataFrame:
    """keys, text, segments: blocks joined with one space in their order, and where each lies. A passage (a section of a book) is one row.

    ``blocks`` has keys, the order, text, pageindex, sourcestart, sourceend.
    """
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("text") + 1).over(w), F.lit(0)).cast("int")
    item = F.struct(F.col(order).alias("o"), "text", "start", (F.col("start") + F.length("text")).alias("end"), "pageindex", "sourcestart", "sourceend")
    packed = blocks.where(F.col("text").isNotNull()).withColumn("start", start).groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("b"))
    segment = lambda x: F.struct(*[x[c].alias(c) for c in ("start", "end", "pageindex", "sourcestart", "sourceend")])
    return packed.select(*keys, F.array_join(F.transform("b", lambda x: x["text"]), " ").alias("text"), F.transform("b", segment).alias("segments"))


def section_passages(blocks: DataFrame) -> DataFrame:
    """bookid, sectionno, text, segments: what is read of each section: prose and references, and all but ornaments where small print is the content. ``blocks`` as ``assign_sections`` gives them."""
    whole = F.coalesce(F.col("sectionkind").isin(*FULL_TEXT_KINDS), F.lit(False)) & (F.col("kind") != "decorative")
    own = blocks.where(F.col("sectionno").isNotNull() & (F.col("kind").isin("prose", "reference") | whole))
    return passages(own.withColumn("_at", F.struct("pageindex", "blockno")), ["bookid", "sectionno"], "_at")


def passage_sentences(passage: DataFrame, keys: list[str]) -> DataFrame:
    """keys, sentno, start, end, sentence."""
    rest = [c for c in passage.columns if c not in (*keys, "text")]
    spread = passage.select(*keys, *rest, F.posexplode(sentences("text")).alias("sentno", "s"))
    return spread.select(*keys, *rest, "sentno", F.col("s.start").alias("start"), (F.col("s.start") + F.length("s.text")).alias("end"), F.col("s.text").alias("sentence"))


def reading_units(found: DataFrame, keys: list[str]) -> DataFrame:
    """keys, unitno (within the passage), text, sentencecount, wordcount, start, end: fixed pairs of sentences, apart where a pair has more than 32 words."""
    pairs = found.withColumn("_pair", F.floor(F.col("sentno") / 2)).withColumn("_words", count_words(F.col("sentence")))
    item = F.struct("sentno", "sentence", "start", "end", "_words")
    grouped = pairs.groupBy(*keys, "_pair").agg(F.array_sort(F.collect_list(item)).alias("s"), F.sum("_words").alias("w"))
    split = (F.size("s") == 2) & (F.col("w") > MOST_WORDS)
    units = grouped.select(*keys, "_pair", F.posexplode(F.when(split, F.transform("s", lambda x: F.array(x))).otherwise(F.array("s"))).alias("_half", "u"))
    return units.select(
        *keys, (F.col("_pair") * 2 + F.col("_half")).cast("int").alias("unitno"), F.array_join(F.transform("u", lambda x: x["sentence"]), " ").alias("text"), F.size("u").alias("sentencecount"),
        F.aggregate("u", F.lit(0), lambda a, x: a + x["_words"]).alias("wordcount"), F.element_at("u", 1)["start"].alias("start"), F.element_at("u", -1)["end"].alias("end"),
    )


def segment_at(segments, offset):
    """The segment that holds an offset, else the last before it, else the first."""
    holds = F.filter(segments, lambda s: (offset >= s["start"]) & (offset < s["end"]))
    before = F.filter(segments, lambda s: s["start"] <= offset)
    return F.coalesce(F.try_element_at(holds, F.lit(1)), F.try_element_at(before, F.lit(-1)), F.try_element_at(segments, F.lit(1)))


def anchored(units: DataFrame) -> DataFrame:
    """``units`` (with segments, start, end, text) with the source position in proportion, the pages touched and the context's hash."""
    first = segment_at(F.col("segments"), F.col("start"))
    pages = F.array_distinct(F.transform(F.filter("segments", lambda s: (s["end"] > F.col("start")) & (s["start"] < F.col("end"))), lambda s: s["pageindex"]))
    size = F.greatest(F.lit(1), F.col("_seg.end") - F.col("_seg.start"))
    source = F.greatest(F.lit(0), F.col("_seg.sourceend") - F.col("_seg.sourcestart"))
    shift = F.least(source, F.greatest(F.lit(0), half_up((F.col("start") - F.col("_seg.start")) / size * source)))
    out = units.withColumn("_seg", first).withColumns({"sourcepages": pages, "pageindex": F.col("_seg.pageindex"), "sourcestart": (F.col("_seg.sourcestart") + shift).cast("int"), "contexttext": F.substring(context_key(F.col("text")), 1, 240)})
    return out.withColumn("contexthash", context_hash("contexttext")).drop("_seg", "segments")


def with_segments(units: DataFrame, passage: DataFrame, keys: list[str]) -> DataFrame:
    """``units`` with the segments of their passage that they touch: both are met stretch by stretch, so that no unit sees the whole passage."""
    over = lambda a, b: F.explode(F.sequence(F.floor(a / STRETCH), F.floor(b / STRETCH))).alias("_stretch")
    segments = passage.select(*keys, F.explode("segments").alias("_s")).select(*keys, "_s", over(F.col("_s.start"), F.col("_s.end")))
    rest = [c for c in units.columns if c not in (*keys, "unitno")]
    own = units.select(*keys, "unitno", F.struct(*rest).alias("_u"), over(F.col("start"), F.col("end")))
    met = own.join(segments, [*keys, "_stretch"]).where((F.col("_s.end") > F.col("_u.start")) & (F.col("_s.start") < F.col("_u.end")))
    packed = met.groupBy(*keys, "unitno").agg(F.first("_u").alias("_u"), F.array_sort(F.collect_set("_s")).alias("segments"))
    return packed.select(*keys, "unitno", *[F.col(f"_u.{c}").alias(c) for c in rest], "segments")


def book_units(blocks: DataFrame, sections: DataFrame) -> DataFrame:
    """The reading units of every book, numbered through it, with section, heading (on the first unit of a section) and anchor; from ``blocks`` with their sections and ``sections``."""
    keys = ["bookid", "sectionno"]
    passage = cut(section_passages(blocks))
    own = cut(reading_units(passage_sentences(passage.select(*keys, "text"), keys), keys))
    counts = own.groupBy(*keys).agg(F.count("*").alias("_n"))
    ahead = counts.withColumn("_ahead", F.sum("_n").over(Window.partitionBy("bookid").orderBy("sectionno")) - F.col("_n")).drop("_n")
    inside = F.row_number().over(Window.partitionBy(*keys).orderBy("unitno")) - 1
    numbered = own.withColumn("_inside", inside).join(ahead, keys).withColumn("unitno", (F.col("_ahead") + F.col("_inside")).cast("int")).drop("_ahead")
    named = sections.where("accepted").select(*keys, F.col("kind").alias("sectionkind"), "title")
    placed = anchored(with_segments(numbered, passage, keys)).join(named, keys)
    return placed.select(
        "bookid", "unitno", "sectionno", "sectionkind", F.when(F.col("_inside") == 0, F.col("title")).alias("heading"), "text", "sentencecount", "wordcount", "pageindex", "sourcestart", "sourcepages", "contexttext", "contexthash"
    )
