"""Positions in books: word offsets, progress, chapter marks, the library's order, and places in a new parse."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirefold.functions import text as T
from quirefold.operators.scans import backward_asof, nearest, running_sum
from quirefold.session import cut


MOST_LEVELS = 256


def unit_rows(predictions: DataFrame) -> DataFrame:
    """bookid, unitno, text, pageindex, readingstart: the units of each book's newest prediction (repeats are equal; the smallest row is taken)."""
    w = Window.partitionBy("bookid").orderBy(F.desc("parserversion"), F.asc_nulls_last("ingestedat"))
    once = predictions.withColumn("_n", F.row_number().over(w)).where("_n = 1")
    return once.select("bookid", F.coalesce("readingstart", F.lit(0)).alias("readingstart"), F.posexplode("readingunits").alias("unitno", "u")).select("bookid", "unitno", F.col("u.text").alias("text"), F.col("u.wordcount").alias("wordcount"), F.col("u.anchor.pageindex").alias("pageindex"), "readingstart")


def section_rows(predictions: DataFrame) -> DataFrame:
    """bookid, sectionno, kind, title, startpage."""
    w = Window.partitionBy("bookid").orderBy(F.desc("parserversion"), F.asc_nulls_last("ingestedat"))
    once = predictions.withColumn("_n", F.row_number().over(w)).where("_n = 1")
    return once.select("bookid", F.posexplode("sections").alias("sectionno", "s")).select("bookid", "sectionno", F.col("s.kind").alias("kind"), F.col("s.title").alias("title"), F.coalesce(F.col("s.startpage"), F.lit(0)).alias("startpage"))


def section_ranges(sections: DataFrame, last_pages: DataFrame) -> DataFrame:
    """``sections`` with endpage: the page before the next section, never before its own start; the book's last page for the last one."""
    w = Window.partitionBy("bookid").orderBy("startpage", "sectionno")
    ends = F.coalesce(F.lead("startpage").over(w) - 1, F.col("lastpage"))
    return sections.join(last_pages.select("bookid", "lastpage"), "bookid", "left").withColumn("endpage", F.greatest("startpage", ends)).drop("lastpage")


def section_parents(sections: DataFrame) -> DataFrame:
    """``sections`` (with level) with parentno, the nearest earlier section of a smaller level; null at the top.

    A window for each level that occurs, however deep: their number (at most MOST_LEVELS) is that of nested headings, not of rows.
    """
    levels = [r["level"] for r in sections.select("level").where(F.col("level").isNotNull()).distinct().orderBy("level").limit(MOST_LEVELS + 1).collect()]
    if len(levels) > MOST_LEVELS:
        raise ValueError("sections have too many levels")
    w = Window.partitionBy("bookid").orderBy("sectionno").rowsBetween(Window.unboundedPreceding, -1)
    at = lambda k: F.last(F.when(F.col("level") == k, F.col("sectionno")), ignorenulls=True).over(w)
    lasts = sections.withColumns({f"_l{i}": at(k) for i, k in enumerate(levels)})
    above = [F.when(F.lit(k) < F.col("level"), F.col(f"_l{i}")) for i, k in enumerate(levels)] + [F.lit(None).cast("int")] * 2
    return lasts.withColumn("parentno", F.greatest(*above)).drop(*[f"_l{i}" for i in range(len(levels))])


def units_in_sections(units: DataFrame, sections: DataFrame) -> DataFrame:
    """``units`` with sectionno and sectionkind of the last section that starts on or before their page."""
    marks = sections.select("bookid", F.col("startpage").alias("pageindex"), F.struct("sectionno", "kind").alias("_section"))
    found = backward_asof(units, marks, ["bookid"], "pageindex", "_section")
    return found.withColumns({"sectionno": F.col("_section.sectionno"), "sectionkind": F.col("_section.kind")}).drop("_section")


def word_offsets(units: DataFrame) -> DataFrame:
    """``units`` with words (0 before the start and in sections that do not count), offset (words before it in its book) and total."""
    counted = (F.col("unitno") >= F.col("readingstart")) & ~F.coalesce(F.col("sectionkind").isin(*T.UNCOUNTED_KINDS), F.lit(False))
    own = units.withColumn("words", F.when(counted, F.coalesce(T.count_words(F.col("text")), F.lit(0))).otherwise(0).cast("long"))
    totals = own.groupBy("bookid").agg(F.sum("words").alias("total"), F.count("*").alias("units"))
    return running_sum(own, ["bookid"], "unitno", "words", "offset").join(totals, "bookid")


def progress(offsets: DataFrame) -> DataFrame:
    """bookid, unitno, fraction: words before a unit by all; the last unit of a longer book is the end."""
    last = (F.col("units") > 1) & (F.col("unitno") == F.col("units") - 1) & (F.col("unitno") > F.least(F.col("readingstart"), F.col("units") - 1))
    fraction = F.when(last, 1.0).when(F.col("total") > 0, F.col("offset") / F.col("total")).otherwise(0.0)
    return offsets.select("bookid", "unitno", F.greatest(F.lit(0.0), F.least(F.lit(1.0), fraction)).alias("fraction"))


def position_summaries(offsets: DataFrame, titles: DataFrame) -> DataFrame:
    """bookid, unitno, pageindex, section, wordsread, words, units: a library row for every place; ``titles`` has bookid, sectionno, section."""
    named = offsets.join(titles, ["bookid", "sectionno"], "left")
    return named.select("bookid", "unitno", "pageindex", "section", F.col("offset").alias("wordsread"), F.col("total").alias("words"), "units")


def chapter_marks(offsets: DataFrame, chapters: DataFrame) -> DataFrame:
    """bookid, marks: where chapters (bookid, unitno, kind) begin as fractions of the words, with 0 and 1; books without chapters or words have no row."""
    own = chapters.where(F.col("kind").isNull() | (F.col("kind") == "chapter")).join(offsets, ["bookid", "unitno"]).where((F.col("unitno") >= F.col("readingstart")) & (F.col("total") > 0))
    fractions = own.withColumn("f", F.col("offset") / F.col("total")).where((F.col("f") >= 0) & (F.col("f") < 1))
    return fractions.groupBy("bookid").agg(F.array_sort(F.array_distinct(F.concat(F.collect_set("f"), F.array(F.lit(0.0), F.lit(1.0))))).alias("marks"))


def shown_progress(fraction: Column, index: Column, start: Column) -> Column:
    """The label of a book's progress; rounding never says it is finished."""
    part = F.least(F.lit(99), T.half_up(fraction * 100)).cast("string")
    return F.when(index <= start, "Not started").when(fraction >= 1, "Finished").otherwise(F.concat(part, F.lit("% read")))


def library_order(books: DataFrame) -> DataFrame:
    """``books`` (id, lastread, imported) with place: opened ones first, then the latest, then the id. Numbered over range partitions, not in one task."""
    from quirefold.operators.scans import number_rows

    keyed = books.withColumns({"_unread": F.col("lastread").isNull(), "_at": F.coalesce("lastread", "imported")})
    return number_rows(keyed, [F.asc("_unread"), F.desc("_at"), F.desc("imported"), F.asc("id")], "place").drop("_unread", "_at")


def library_search(books: DataFrame, query: str) -> DataFrame:
    """Books whose title or file name holds the query, literally and whatever its case; a blank query finds all."""
    q = query.strip().lower()
    return books.where(F.lit(q == "") | F.contains(F.lower(F.coalesce("title", F.lit(""))), F.lit(q)) | F.contains(F.lower(F.coalesce("filename", F.lit(""))), F.lit(q)))


def remap(anchors: DataFrame, units: DataFrame) -> DataFrame:
    """bookid, anchorid, unitno, confidence, how: where old places lie in a new parse.

    ``anchors`` has bookid, anchorid, contexttext, contexthash, pageindex, sourcestart; ``units`` bookid, unitno, contexttext, contexthash, pageindex,
    sourcestart, sourcepages. By equal hash, else by a unique unit at the same place whose context begins the old one, else by shared runs of three words and
    nearness of pages. Only units that share a run, or are nearest by page, can be best, so no unit meets every anchor. Books without units give no row.
    """
    exact = anchors.join(units.select("bookid", "contexthash", "unitno"), ["bookid", "contexthash"]).groupBy("bookid", "anchorid").agg(F.min("unitno").alias("unitno"))
    exact = exact.select("bookid", "anchorid", "unitno", F.lit(0.995).alias("confidence"), F.lit("hash").alias("how"))
    rest = anchors.join(exact, ["bookid", "anchorid"], "left_anti")
    u = units.select("bookid", "unitno", F.col("contexttext").alias("newtext"), "pageindex", "sourcestart")
    begins = rest.join(u, ["bookid", "pageindex", "sourcestart"]).where((F.col("newtext") != "") & F.startswith(F.col("contexttext"), F.concat("newtext", F.lit(" "))))
    prefix = begins.groupBy("bookid", "anchorid").agg(F.min("unitno").alias("unitno"), F.count("*").alias("n")).where("n = 1")
    prefix = prefix.select("bookid", "anchorid", "unitno", F.lit(0.99).alias("confidence"), F.lit("prefix").alias("how"))
    rest = cut(rest.join(prefix, ["bookid", "anchorid"], "left_anti").select("bookid", "anchorid", "pageindex", T.context_grams(F.col("contexttext")).alias("g")))
    grams = units.select("bookid", "unitno", F.explode(T.context_grams(F.col("contexttext"))).alias("gram"))
    shared = rest.select("bookid", "anchorid", F.explode("g").alias("gram")).join(grams, ["bookid", "gram"]).groupBy("bookid", "anchorid", "unitno").agg(F.count("*").alias("n"))
    pages = units.select("bookid", "unitno", F.explode("sourcepages").alias("pageindex"))
    near = nearest(rest.select("bookid", "anchorid", "pageindex"), pages, ["bookid"], "pageindex", "unitno").where(F.col("unitno").isNotNull()).select("bookid", "anchorid", "unitno", F.lit(0).cast("long").alias("n"))
    pairs = shared.unionByName(near).groupBy("bookid", "anchorid", "unitno").agg(F.max("n").alias("n"))
    pairs = pairs.join(rest.select("bookid", "anchorid", "pageindex", F.size("g").alias("a")), ["bookid", "anchorid"]).join(units.select("bookid", "unitno", F.size(T.context_grams(F.col("contexttext"))).alias("b"), "sourcepages"), ["bookid", "unitno"])
    context = F.when((F.col("a") > 0) & (F.col("b") > 0), 2.0 * F.col("n") / (F.col("a") + F.col("b"))).otherwise(0.0)
    same = F.array_contains("sourcepages", F.col("pageindex"))
    distance = F.array_min(F.transform("sourcepages", lambda p: F.abs(p - F.col("pageindex"))))
    scored = pairs.withColumns({"context": context, "same": same}).withColumn("score", F.col("context") * 0.82 + F.when(F.col("same"), 0.16).otherwise(F.greatest(F.lit(0.0), 0.08 - distance * 0.02)))
    best = scored.groupBy("bookid", "anchorid").agg(F.min(F.struct((-F.col("score")).alias("minus"), "unitno", "context", "same")).alias("b"))
    score = -F.col("b.minus")
    sure = F.when((F.col("b.context") >= 0.92) & F.col("b.same"), F.greatest(F.lit(0.9), score)).otherwise(F.least(F.lit(0.89), score))
    similar = best.select("bookid", "anchorid", F.col("b.unitno").alias("unitno"), sure.alias("confidence"), F.lit("similarity").alias("how"))
    return exact.unionByName(prefix).unionByName(similar)


def remap_in_documents(anchors: DataFrame, units: DataFrame) -> DataFrame:
    """bookid, anchorid, unitno, confidence, how for places in EPUB documents.

    As ``remap`` but within the anchor's document (path): the nearest unit of equal hash, a unique one at the same offset whose context begins the old one, else
    the most alike unit of the document, or of the book if it has no such document any more. Books without units give no row. Only documents with an anchor that
    neither hash nor offset placed are taken apart into runs of words. Joins are merges: of rows that came out of arrays the planner knows no size, and it would
    broadcast the runs of all books.
    """
    merged = lambda a, b, on, how="inner": a.join(b.hint("merge"), on, how)
    same = merged(anchors, units.select("bookid", "path", "contexthash", "unitno", F.col("sourcestart").alias("_s")), ["bookid", "path", "contexthash"])
    exact = same.groupBy("bookid", "anchorid").agg(F.min(F.struct(F.abs(F.col("_s") - F.col("sourcestart")).alias("d"), "unitno")).alias("b"))
    exact = cut(exact.select("bookid", "anchorid", "b.unitno", F.lit(0.995).alias("confidence"), F.lit("hash").alias("how")))
    rest = cut(merged(anchors, exact, ["bookid", "anchorid"], "left_anti"))
    if rest.isEmpty():
        return exact
    begins = merged(rest, units.select("bookid", "path", "sourcestart", "unitno", F.col("contexttext").alias("_t")), ["bookid", "path", "sourcestart"]).where((F.col("_t") != "") & F.startswith("contexttext", F.concat("_t", F.lit(" "))))
    prefix = begins.groupBy("bookid", "anchorid").agg(F.min("unitno").alias("unitno"), F.count("*").alias("n")).where("n = 1").select("bookid", "anchorid", "unitno", F.lit(0.99).alias("confidence"), F.lit("prefix").alias("how"))
    rest = merged(rest, prefix, ["bookid", "anchorid"], "left_anti")
    documents = units.select("bookid", "path", F.lit(True).alias("_known")).distinct()
    rest = cut(merged(rest, documents, ["bookid", "path"], "left").select("bookid", "anchorid", "sourcestart", F.when(F.col("_known"), F.col("path")).otherwise("").alias("scope"), T.context_grams(F.col("contexttext")).alias("g")))
    own = units.select("bookid", "unitno", "sourcestart", F.explode(F.array("path", F.lit(""))).alias("scope"), "contexttext")
    scoped = merged(own, rest.select("bookid", "scope").distinct(), ["bookid", "scope"], "left_semi").withColumn("h", T.context_grams(F.col("contexttext"))).drop("contexttext")
    shared = merged(rest.select("bookid", "scope", "anchorid", F.explode("g").alias("gram")), scoped.select("bookid", "scope", "unitno", F.explode("h").alias("gram")), ["bookid", "scope", "gram"]).groupBy("bookid", "scope", "anchorid", "unitno").agg(F.count("*").alias("n"))
    none = F.lit(0).cast("long").alias("n")
    level = merged(rest.select("bookid", "scope", "anchorid", "sourcestart"), scoped.select("bookid", "scope", "sourcestart", "unitno"), ["bookid", "scope", "sourcestart"]).select("bookid", "scope", "anchorid", "unitno", none)
    first = merged(rest.select("bookid", "scope", "anchorid"), scoped.groupBy("bookid", "scope").agg(F.min("unitno").alias("unitno")), ["bookid", "scope"]).select("bookid", "scope", "anchorid", "unitno", none)
    pairs = shared.unionByName(level).unionByName(first).groupBy("bookid", "scope", "anchorid", "unitno").agg(F.max("n").alias("n"))
    pairs = merged(merged(pairs, rest.select("bookid", "anchorid", F.col("sourcestart").alias("_a"), F.size("g").alias("a")), ["bookid", "anchorid"]), scoped.select("bookid", "scope", "unitno", "sourcestart", F.size("h").alias("b")), ["bookid", "scope", "unitno"])
    context = F.when((F.col("a") > 0) & (F.col("b") > 0), 2.0 * F.col("n") / (F.col("a") + F.col("b"))).otherwise(0.0)
    score = context * 0.85 + F.when(F.col("_a") == F.col("sourcestart"), 0.1).otherwise(0.0)
    best = pairs.groupBy("bookid", "anchorid").agg(F.min(F.struct((-score).alias("minus"), "unitno")).alias("b"))
    similar = best.select("bookid", "anchorid", "b.unitno", F.least(F.lit(0.89), -F.col("b.minus")).alias("confidence"), F.lit("similarity").alias("how"))
    return exact.unionByName(prefix).unionByName(similar)


PROBE, STEP, LEAST_PROBE, REACH = 60, 24, 30, 360


def chapter_units(chapters: DataFrame, units: DataFrame, pages: DataFrame) -> DataFrame:
    """``chapters`` (bookid, chapterno, title, pageindex, endline) with unitno, the reading unit where each begins; those that lead nowhere are left out.

    The first unit of the chapter's page that holds its title; else one that holds a stretch of the page's text behind the heading; else the page's first unit;
    else the first unit of a later page.
    """
    nav = lambda c: T.key(T.navigation_title(c))
    chapters = cut(chapters)
    own = chapters.select("bookid", "chapterno", "pageindex", "endline", nav(F.col("title")).alias("_title"))
    u = units.where(F.length(F.trim("text")) > 0).select("bookid", "unitno", F.col("pageindex"), nav(F.col("text")).alias("_key"))
    u = cut(u)  # read by every way of finding a chapter's unit
    here = own.join(u, ["bookid", "pageindex"])
    titled = here.where(F.contains("_key", F.col("_title"))).groupBy("bookid", "chapterno").agg(F.min("unitno").alias("u1"))
    body = F.array_join(F.slice(F.split("text", "\n"), F.col("endline") + 1, 1_000_000), " ")
    behind = own.join(pages.select("bookid", "pageindex", "text"), ["bookid", "pageindex"]).select("bookid", "chapterno", "pageindex", nav(body).alias("_behind"))
    spots = F.filter(F.sequence(F.lit(0), F.lit(REACH - 1), F.lit(STEP)), lambda i: i + LEAST_PROBE <= F.length("_behind"))
    probes = behind.select("bookid", "chapterno", "pageindex", F.posexplode(F.transform(spots, lambda i: F.substring(F.col("_behind"), i + 1, PROBE))).alias("no", "probe"))
    on_page = probes.join(u, ["bookid", "pageindex"]).where(F.contains("_key", F.col("probe")))
    paged = here.select("bookid", "chapterno").distinct()
    lost = cut(probes.join(paged, ["bookid", "chapterno"], "left_anti"))
    # A unit that holds a probe holds the run of three words inside it; a probe of fewer whole words meets its book's units.
    whole = F.slice(F.split("probe", " "), 2, F.greatest(F.size(F.split("probe", " ")) - 2, F.lit(0)))
    lost = lost.withColumn("gram", F.when(F.size(whole) >= 3, F.array_join(F.slice(whole, 1, 3), " ")))
    grams = u.select("bookid", "unitno", F.explode(T.context_grams(F.col("_key"))).alias("gram")).join(lost.select("bookid", "gram").distinct(), ["bookid", "gram"], "left_semi")
    met = lost.where("gram is not null").join(grams, ["bookid", "gram"]).join(u.drop("pageindex"), ["bookid", "unitno"])
    few = lost.where("gram is null").join(u.drop("pageindex"), "bookid")
    held = ["bookid", "chapterno", "no", "probe", "unitno", "_key"]
    anywhere = met.select(*held).unionByName(few.select(*held)).where(F.contains("_key", F.col("probe")))
    probed = on_page.select("bookid", "chapterno", "no", "unitno").unionByName(anywhere.select("bookid", "chapterno", "no", "unitno")).groupBy("bookid", "chapterno").agg(F.min(F.struct("no", "unitno")).alias("b")).select("bookid", "chapterno", F.col("b.unitno").alias("u2"))
    first = here.groupBy("bookid", "chapterno").agg(F.min("unitno").alias("u3"))
    minus = u.select("bookid", (-F.col("pageindex")).alias("_minus"), F.struct((-F.col("unitno")).alias("u")).alias("_later"))
    later = backward_asof(own.select("bookid", "chapterno", (-F.col("pageindex")).alias("_minus")), minus, ["bookid"], "_minus", "_later").select("bookid", "chapterno", (-F.col("_later.u")).alias("u4"))
    found = chapters
    for part in (titled, probed, first, later):
        found = found.join(part, ["bookid", "chapterno"], "left")
    return found.withColumn("unitno", F.coalesce("u1", "u2", "u3", "u4")).drop("u1", "u2", "u3", "u4").where(F.col("unitno").isNotNull())


def current_chapters(units: DataFrame, chapters: DataFrame) -> DataFrame:
    """bookid, unitno, title: the last chapter (bookid, unitno, title) that begins at or before each unit."""
    marks = chapters.select("bookid", "unitno", F.struct("title").alias("_chapter"))
    return backward_asof(units.select("bookid", "unitno"), marks, ["bookid"], "unitno", "_chapter").select("bookid", "unitno", F.col("_chapter.title").alias("title"))
