"""Gold against prediction, corpus summaries and unlabelled audits."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructField, StructType

from quirefold.functions import text as T


def newest(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def ratio(part: Column, whole: Column, other_empty: Column) -> Column:
    """part / whole; where whole is empty, 1 if the other side is too, else 0."""
    return F.when(whole > 0, part / whole).otherwise(F.when(other_empty, 1.0).otherwise(0.0))


def f1(p: Column, r: Column) -> Column:
    return F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)


def greedy_matches(gold: list[dict], predicted: list[dict], fits) -> int:
    """How many gold entries find a partner, each taking the first one free that fits."""
    free = list(range(len(predicted)))
    n = 0
    for g in gold:
        hit = next((i for i in free if fits(g, predicted[i])), None)
        if hit is not None:
            free.remove(hit)
            n += 1
    return n


def _rates(n: int, gold: int, predicted: int) -> tuple[float, float, float]:
    p = n / predicted if predicted else float(not gold)
    r = n / gold if gold else float(not predicted)
    return p, r, 2 * p * r / (p + r) if p + r else 0.0


def _word_dice(a: str | None, b: str | None) -> float:
    import re

    x, y = (set(re.sub(r"[^\w]+", " ", (t or "").casefold()).split()) for t in (a, b))
    return 2 * len(x & y) / (len(x) + len(y)) if x and y else 0.0


SECTION_SCORES = StructType([StructField(c, DoubleType()) for c in ("chapterprecision", "chapterrecall", "boundaryexact", "boundarynear")]).add("kinds", ArrayType(StructType().add("kind", StringType()).add("f1", DoubleType())))


@pandas_udf(SECTION_SCORES)
def section_scores(gold: pd.Series, predicted: pd.Series) -> pd.DataFrame:
    def one(g, p):
        g, p = list(g) if g is not None else [], list(p) if p is not None else []
        page = lambda s: int(s["startpage"] or 0)
        near = lambda a, b: a["kind"] == b["kind"] and abs(page(a) - page(b)) <= 1
        exact = lambda a, b: a["kind"] == b["kind"] and page(a) == page(b)
        named = lambda a, b: near(a, b) and _word_dice(a["title"], b["title"]) >= 0.72
        gc, pc = ([s for s in x if s["kind"] in ("chapter", "part")] for x in (g, p))
        chapters = _rates(greedy_matches(gc, pc, named), len(gc), len(pc))
        kinds = []
        for kind in sorted({s["kind"] or "unknown" for s in [*g, *p]}):
            gk, pk = ([s for s in x if (s["kind"] or "unknown") == kind] for x in (g, p))
            kinds.append({"kind": kind, "f1": _rates(greedy_matches(gk, pk, lambda a, b: abs(page(a) - page(b)) <= 1), len(gk), len(pk))[2]})
        return chapters[0], chapters[1], _rates(greedy_matches(g, p, exact), len(g), len(p))[1], _rates(greedy_matches(g, p, near), len(g), len(p))[1], kinds

    return pd.DataFrame([one(g, p) for g, p in zip(gold, predicted)], columns=["chapterprecision", "chapterrecall", "boundaryexact", "boundarynear", "kinds"])


def paired(gold: DataFrame, predictions: DataFrame) -> DataFrame:
    """One row per book with both; repeated rows count once."""
    g = newest(gold, "bookid", [F.asc_nulls_last("ingestedat")]).select("bookid", F.col("title").alias("goldtitle"), "readingstartpage", F.col("sections").alias("goldsections"), "bodywordcount", "runningfurniture", F.col("sentenceends").alias("goldends"))
    p = newest(predictions, "bookid", [F.desc("parserversion"), F.asc_nulls_last("ingestedat")]).select("bookid", F.col("metadata.title.value").alias("title"), "sections", "readingunits", "readingstart", "sentenceends")
    return g.join(p, "bookid")


def book_scores(gold: DataFrame, predictions: DataFrame) -> DataFrame:
    """bookid, titleaccuracy, startnear, retention, leakage, sentenceprecision, sentencerecall, sentencef1 of every book with both."""
    both = paired(gold, predictions)
    empty = F.array().cast("array<string>")
    count = lambda u: F.coalesce(u["wordcount"], T.count_words(F.coalesce(u["text"], F.lit(""))))
    words = F.aggregate(F.coalesce("readingunits", F.array().cast(dict(predictions.dtypes)["readingunits"])), F.lit(0), lambda a, u: a + count(u))
    first = F.try_element_at("readingunits", F.coalesce("readingstart", F.lit(0)) + 1)["anchor"]["pageindex"]
    text = T.word_key(F.array_join(F.transform("readingunits", lambda u: F.coalesce(u["text"], F.lit(""))), " "))
    both = both.withColumns({"_words": words, "_text": text, "_first": F.when(F.coalesce("readingstart", F.lit(0)) >= 0, F.coalesce(first, F.lit(0))).otherwise(0)})
    lines = F.array_distinct(F.filter(F.transform(F.coalesce("runningfurniture", empty), T.word_key), lambda k: k != ""))
    leaked = F.aggregate(F.filter(lines, lambda k: F.contains(F.col("_text"), k)), F.lit(0), lambda a, k: a + F.size(F.split(k, " ")))
    g, p = F.array_distinct(F.coalesce("goldends", empty)), F.array_distinct(F.coalesce("sentenceends", empty))
    both = both.withColumns({"_g": F.size(g), "_p": F.size(p), "_both": F.size(F.array_intersect(g, p))})
    precision, recall = ratio(F.col("_both"), F.col("_p"), F.col("_g") == 0), ratio(F.col("_both"), F.col("_g"), F.col("_p") == 0)
    return both.select(
        "bookid", (T.word_key(F.coalesce("goldtitle", F.lit(""))) == T.word_key(F.coalesce("title", F.lit("")))).cast("double").alias("titleaccuracy"),
        (F.abs(F.col("_first") - F.coalesce("readingstartpage", F.lit(0))) <= 1).cast("double").alias("startnear"),
        F.round(F.when(F.col("bodywordcount") > 0, F.least(F.lit(1.0), F.col("_words") / F.col("bodywordcount"))).otherwise(1.0), 6).alias("retention"),
        F.round(leaked / F.greatest(F.lit(1), F.col("_words")), 6).alias("leakage"),
        F.round(precision, 6).alias("sentenceprecision"), F.round(recall, 6).alias("sentencerecall"), F.round(f1(precision, recall), 6).alias("sentencef1"),
    )


def book_section_scores(gold: DataFrame, predictions: DataFrame) -> DataFrame:
    """bookid, kinds and the section scores of every book with both; partners are taken greedily in the sections' order."""
    return paired(gold, predictions).select("bookid", section_scores("goldsections", "sections").alias("s")).select("bookid", "s.*")


def corpus_scores(scores: DataFrame, sections: DataFrame) -> DataFrame:
    """metric, value: means over books, and the mean over kinds of each kind's mean over the books that have it."""
    both = scores.join(sections.drop("kinds"), "bookid", "full")
    names = [c for c in both.columns if c != "bookid"]
    means = both.agg(*[F.round(F.avg(c), 6).alias(c) for c in names]).select(F.explode(F.map_from_arrays(F.array(*[F.lit(c) for c in names]), F.array(*names))).alias("metric", "value"))
    kinds = sections.select(F.explode("kinds").alias("k")).groupBy("k.kind").agg(F.avg("k.f1").alias("f")).agg(F.round(F.avg("f"), 6).alias("value")).select(F.lit("sectionmacrof1").alias("metric"), "value")
    return means.unionByName(kinds)


def corpus_summary(manifest: DataFrame, pages: DataFrame, predictions: DataFrame) -> DataFrame:
    """One row: books with pages, their publishers and subjects, pages per book, share with an outline."""
    own = manifest.groupBy("id").agg(F.max("publisher").alias("publisher"), F.max("subjects").alias("subjects"), F.max("hasoutline").alias("hasoutline"))
    counts = pages.groupBy(F.col("bookid").alias("id")).agg(F.count_distinct("pageindex").alias("pages"))
    books = own.join(counts, "id")
    subjects = books.select(F.explode("subjects").alias("subject")).agg(F.count_distinct("subject").alias("subjects"))
    per = books.agg(
        F.count("*").alias("documents"), F.count_distinct(F.when(F.col("publisher") != "", F.col("publisher"))).alias("publishers"), F.min("pages").alias("minpages"), F.median("pages").alias("medianpages"), F.max("pages").alias("maxpages"),
        F.round(F.avg(F.coalesce(F.col("hasoutline"), F.lit(False)).cast("double")), 4).alias("outlineshare"),
    )
    return per.join(subjects)


def kind_histogram(predictions: DataFrame) -> DataFrame:
    """kind, n, place: section kinds, the most common first; equal ones in the order in which they are met."""
    once = newest(predictions, "bookid", [F.desc("parserversion"), F.asc_nulls_last("ingestedat")])
    spread = once.select("bookid", F.posexplode("sections").alias("pos", "s")).select(F.coalesce("s.kind", F.lit("unknown")).alias("kind"), "bookid", "pos")
    counts = spread.groupBy("kind").agg(F.count("*").alias("n"), F.min(F.struct("bookid", "pos")).alias("first"))
    return counts.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "first"))).select("kind", "n", "place")  # a row per kind


def font_medians(spans: DataFrame) -> DataFrame:
    """bookid, medianfontsize over the spans with a size; repeated spans count once. Sizes are counted first, so a hot book is a few rows."""
    sizes = spans.where("fontsize > 0").select("bookid", "pageindex", "spanindex", "fontsize").distinct().groupBy("bookid", "fontsize").agg(F.count("*").alias("n"))
    w = Window.partitionBy("bookid").orderBy("fontsize")
    ranked = sizes.withColumns({"upto": F.sum("n").over(w), "all": F.sum("n").over(Window.partitionBy("bookid"))})
    low = F.min(F.when(F.col("upto") >= F.floor((F.col("all") + 1) / 2), F.col("fontsize")))
    high = F.min(F.when(F.col("upto") >= F.floor(F.col("all") / 2) + 1, F.col("fontsize")))
    return ranked.groupBy("bookid").agg(F.bround((low + high) / 2, 3).alias("medianfontsize"))


def book_audit(pages: DataFrame, units: DataFrame) -> DataFrame:
    """bookid, pages, sourcewords, readingwords, ratio, units, oversized, maxwords: words here are runs of word characters, small letters."""
    once = pages.groupBy("bookid", "pageindex").agg(F.max(F.coalesce("text", F.lit(""))).alias("text"))
    word = lambda c: F.regexp_count(F.coalesce(c, F.lit("")), F.lit("[\\p{L}\\p{N}_]+"))
    source = once.groupBy("bookid").agg(F.count("*").alias("pages"), F.sum(word(F.col("text"))).alias("sourcewords"))
    read = units.groupBy("bookid").agg(F.sum(word(F.col("text"))).alias("readingwords"), F.count("*").alias("units"), F.sum((F.col("wordcount") > 250).cast("long")).alias("oversized"), F.max("wordcount").alias("maxwords"))
    return source.join(read, "bookid").select(
        "bookid", "pages", "sourcewords", "readingwords", F.bround(F.col("readingwords") / F.greatest(F.lit(1), F.col("sourcewords")), 4).alias("ratio"), "units", F.coalesce("oversized", F.lit(0)).alias("oversized"), F.coalesce("maxwords", F.lit(0)).alias("maxwords")
    )
