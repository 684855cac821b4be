"""Further queries: counts and checks over the tables, stored books, and rules that parses must keep, each with its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirefold.functions import text as T
from quirefold.operators import inventory, layout, progress, repairs, scans, scorecard, units
from quirefold.plans import catalog as C
from quirefold.plans import sqltext as S
from quirefold.plans.catalog import query
from quirefold.session import checkpoint_dir, cut, table
from quirefold.sources import epub, tables
from quirefold.streaming import ingest

LETTERS = "[^\\p{L}\\p{N}]+"


def _gold(spark: SparkSession, d: str) -> DataFrame:
    return scorecard.newest(table(spark, d, "annotation"), "bookid", [F.asc_nulls_last("ingestedat")])


def _newest(spark: SparkSession, d: str) -> DataFrame:
    return scorecard.newest(table(spark, d, "prediction"), "bookid", [F.desc("parserversion"), F.asc_nulls_last("ingestedat")])


# --- counts and checks ----------------------------------------------------------------------------------------------


@query(f"""WITH {C.ONE_PREDICTION}, p AS (SELECT bookid, count(DISTINCT pageindex) n FROM page_extraction GROUP BY 1), s AS (SELECT bookid, count(*) n FROM (SELECT DISTINCT bookid, pageindex, spanindex FROM text_span) GROUP BY 1),
l AS (SELECT bookid, count(*) n FROM (SELECT DISTINCT bookid, pageindex, lineindex FROM text_span) GROUP BY 1), k AS (SELECT bookid FROM p UNION SELECT bookid FROM s UNION SELECT bookid FROM pred1 WHERE len(readingunits) > 0 OR len(sections) > 0)
SELECT k.bookid, coalesce(p.n, 0) AS n_pages, coalesce(s.n, 0) AS n_spans, coalesce(l.n, 0) AS n_lines, coalesce(CAST(len(readingunits) AS BIGINT), 0) AS n_units, coalesce(CAST(len(sections) AS BIGINT), 0) AS n_sections
FROM k LEFT JOIN p ON p.bookid = k.bookid LEFT JOIN s ON s.bookid = k.bookid LEFT JOIN l ON l.bookid = k.bookid LEFT JOIN pred1 ON pred1.bookid = k.bookid""")
def parse_counts(spark: SparkSession, d: str) -> DataFrame:
    """Pages, spans, lines, units and sections of every book."""
    spans, predictions = table(spark, d, "text_span"), table(spark, d, "prediction")
    return inventory.counts_by_book({
        "pages": (table(spark, d, "page_extraction"), ["pageindex"]), "spans": (spans, ["pageindex", "spanindex"]), "lines": (spans, ["pageindex", "lineindex"]),
        "units": (progress.unit_rows(predictions), ["unitno"]), "sections": (progress.section_rows(predictions), ["sectionno"]),
    })


@query(f"WITH {C.ONE_PREDICTION} SELECT parserversion, count(*) AS n, round(avg(metadata.title.confidence), 6) AS confidence FROM pred1 GROUP BY 1")
def title_confidence(spark: SparkSession, d: str) -> DataFrame:
    return inventory.mean_confidence(_newest(spark, d).select("parserversion", F.col("metadata.title.confidence").alias("c")), ["parserversion"], "c")


@query(f"""WITH {C.ONE_RECORD}, a AS (SELECT count(DISTINCT CASE WHEN trim(publisher) <> '' THEN publisher END) AS n_publishers, count(DISTINCT pagetier) AS n_tiers, round(avg(CASE WHEN coalesce(hasoutline, false) THEN 1.0 ELSE 0.0 END), 6) AS outline_share FROM man1),
b AS (SELECT count(DISTINCT s) AS n_subjects FROM (SELECT unnest(subjects) s FROM man1))
SELECT n_publishers, n_subjects, n_tiers, outline_share, concat_ws(',', CASE WHEN n_publishers < 20 THEN 'n_publishers' END, CASE WHEN n_subjects < 1000000 THEN 'n_subjects' END, CASE WHEN n_tiers < 3 THEN 'n_tiers' END, CASE WHEN outline_share < 0.9 THEN 'outline_share' END) AS missed FROM a, b""")
def corpus_stratification(spark: SparkSession, d: str) -> DataFrame:
    return inventory.stratification(C.records(spark, d), publishers=20, subjects=1_000_000, tiers=3, outlines=0.9)


@query(f"SELECT count(*) AS books, CAST(sum(pages) AS BIGINT) AS pages, CAST(sum(sourcewords) AS BIGINT) AS sourcewords, CAST(sum(readingwords) AS BIGINT) AS readingwords, CAST(sum(units) AS BIGINT) AS units, CAST(sum(oversized) AS BIGINT) AS oversized, max(maxwords) AS maxwords FROM ({C.SQL['book_audit']})")
def audit_totals(spark: SparkSession, d: str) -> DataFrame:
    return inventory.audit_totals(C.QUERIES["book_audit"](spark, d))


@query(f"WITH {C.ONE_RECORD} SELECT id, title FROM man1 WHERE split = 'discovery' AND id IN (SELECT bookid FROM annotation)")
def selected_records(spark: SparkSession, d: str) -> DataFrame:
    """Records of a split that have gold."""
    gold = table(spark, d, "annotation").select(F.col("bookid").alias("id"))
    return inventory.selected(C.records(spark, d), gold, "discovery").select("id", "title")


@query("SELECT doc_id, sha256(text) AS sha256 FROM documents WHERE text IS NOT NULL")
def content_hashes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where(F.col("text").isNotNull()).select("doc_id", F.sha2("text", 256).alias("sha256"))


@query(f"""WITH {C.ONE_RECORD}, v AS (SELECT id, list_filter([trim(x) FOR x IN list_concat([doi], coalesce(isbns, []))], lambda x: coalesce(x, '') <> '') AS i, list_filter([trim(x) FOR x IN list_concat(coalesce(authors, []), [publisher])], lambda x: coalesce(x, '') <> '') AS c FROM man1)
SELECT id, array_to_string(list_filter(i, lambda x, n: list_position(i, x) = n), '|') AS identifiers, c[1] AS contributor FROM v""")
def metadata_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Catalogue records as key and value pairs, read by key and by the keys below one."""
    pair = lambda k, v: F.struct(F.lit(k).alias("key"), v.alias("value"))
    many = lambda k, c: F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: pair(k, x))
    c = F.col
    entries = F.concat(F.array(pair("dc.identifier.doi", c("doi"))), many("DC.identifier.isbn", c("isbns")), many("dc.contributor.author", c("authors")), F.array(pair("dc.publisher ", c("publisher"))))
    own = C.records(spark, d).withColumn("m", inventory.multimap(entries))
    return own.select("id", F.array_join(inventory.values_of(c("m"), "dc.identifier"), "|").alias("identifiers"), inventory.first_of(c("m"), "dc.contributor", "dc.publisher").alias("contributor"))


def _sql_grams(k: str) -> str:
    w = f"list_filter(string_split({k}, ' '), lambda w: w <> '')"
    return f"list_distinct(CASE WHEN len({w}) < 3 THEN {w} ELSE list_transform(range(1, len({w}) - 1), lambda i: {w}[i] || ' ' || {w}[i + 1] || ' ' || {w}[i + 2]) END)"


@query(f"""WITH {C.GOLD1}, {C.ONE_RECORD}, t AS (SELECT bookid, {_sql_grams(S.context_key("coalesce(g.title, '')"))} a, {_sql_grams(S.context_key("coalesce(m.title, '')"))} b FROM gold1 g JOIN man1 m ON m.id = g.bookid)
SELECT bookid, round(CASE WHEN len(a) > 0 AND len(b) > 0 THEN {C._dice('a', 'b')} ELSE 0 END, 6) AS similarity FROM t""")
def context_similarity(spark: SparkSession, d: str) -> DataFrame:
    """Shared runs of three words of gold titles and the manifest's."""
    both = _gold(spark, d).select("bookid", F.col("title").alias("a")).join(C.records(spark, d).select(F.col("id").alias("bookid"), F.col("title").alias("b")), "bookid")
    keys = both.select("bookid", *[T.context_key(F.coalesce(c, F.lit(""))).alias(c) for c in ("a", "b")])
    return keys.select("bookid", F.round(T.gram_similarity(T.context_grams(F.col("a")), T.context_grams(F.col("b"))), 6).alias("similarity"))


# --- stored books and snapshots -------------------------------------------------------------------------------------


@query(f"WITH {C.UNITS} SELECT bookid, count(*) AS n_units, CAST(coalesce(sum(length(u.text)), 0) AS BIGINT) AS characters, 0 AS n_differences FROM units GROUP BY 1")
def stored_units(spark: SparkSession, d: str) -> DataFrame:
    """Reading units written as JSON and as books in buckets, one book put again, and both read back."""
    own = progress.unit_rows(table(spark, d, "prediction")).select("bookid", "unitno", "text")
    at = f"{checkpoint_dir(spark)}/stored-{uuid.uuid4().hex[:12]}"
    tables.write_json(own, f"{at}/json")
    tables.write_books(own, f"{at}/books")
    again = own.join(own.agg(F.min("bookid").alias("bookid")), "bookid", "left_semi")
    tables.write_books(again, f"{at}/books")
    json, books = tables.read_json(spark, f"{at}/json", "bookid string, unitno int, text string").where("_corrupt is null").drop("_corrupt"), tables.read_books(spark, f"{at}/books")
    apart = tables.differences(json.select(own.columns), books.select(own.columns)).groupBy("bookid").agg(F.count("*").cast("int").alias("n_differences"))
    per = books.groupBy("bookid").agg(F.count("*").alias("n_units"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("characters"))
    return per.join(apart, "bookid", "left").select("bookid", "n_units", "characters", F.coalesce("n_differences", F.lit(0)).alias("n_differences"))


@query(f"""WITH a AS (WITH {C.ONE_RECORD} SELECT id, split FROM man1), b AS (SELECT id, newsplit AS split FROM ({C.SQL['quota_splits']}))
SELECT *, 'left' AS side FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT *, 'right' FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)""")
def split_changes(spark: SparkSession, d: str) -> DataFrame:
    """What a new assignment of splits changes: two snapshots compared."""
    return tables.differences(C.records(spark, d).select("id", "split"), C.QUERIES["quota_splits"](spark, d).select("id", F.col("newsplit").alias("split")))


@query(f"""WITH {C.ONE_PREDICTION}, {C.GOLD1}, r AS (SELECT bookid, CASE WHEN len(sections) % 2 = 0 THEN 1 ELSE 3 END v, len(sections) n FROM gold1)
SELECT p.bookid, CAST(CASE WHEN r.v > 2 THEN r.n ELSE len(p.sections) END AS INT) AS n_chapters, CAST(CASE WHEN r.v > 2 THEN 3 ELSE 2 END AS INT) AS chapterversion FROM pred1 p LEFT JOIN r ON r.bookid = p.bookid""")
def repaired_navigation(spark: SparkSession, d: str) -> DataFrame:
    """Stored chapters, as JSON, under repaired ones of a newer version."""
    name = lambda s: F.to_json(F.transform(s, lambda x: F.struct(x["title"].alias("title"))))
    stored = _newest(spark, d).select("bookid", F.lit("pdf").alias("format"), F.lit(1).alias("revision"), F.lit(2).alias("chapterversion"), name(F.col("sections")).alias("raw"))
    stored = tables.parse_content(stored, "raw", "array<struct<title:string>>").withColumnRenamed("content", "chapters").drop("raw")
    newer = F.when(F.size("sections") % 2 == 0, 1).otherwise(3)
    repaired = _gold(spark, d).select("bookid", F.lit(1).alias("revision"), newer.alias("chapterversion"), F.transform("sections", lambda s: F.struct(s["title"].alias("title"))).alias("chapters"))
    return tables.overlay_navigation(stored, repaired).select("bookid", F.size("chapters").alias("n_chapters"), F.col("chapterversion").cast("int").alias("chapterversion"))


def _chapters(spark: SparkSession, d: str) -> DataFrame:
    return progress.section_rows(table(spark, d, "prediction")).select("bookid", F.col("sectionno").alias("chapterno"), "kind", "title", F.col("startpage").alias("pageindex"))


@query(f"""WITH {C.SECTIONS}, k AS (SELECT *, {S.key('title')} k FROM sections)
SELECT bookid, CAST(sectionno AS INT) AS chapterno FROM k a WHERE NOT coalesce(kind <> 'part' AND EXISTS (SELECT 1 FROM k b WHERE b.bookid = a.bookid AND b.startpage = a.startpage AND b.kind <> 'part' AND b.sectionno < a.sectionno AND (b.k = a.k OR starts_with(b.k, a.k || ' ') OR starts_with(a.k, b.k || ' '))), false)""")
def distinct_chapters(spark: SparkSession, d: str) -> DataFrame:
    """Predicted sections without those whose title repeats or continues one before it on the page."""
    return repairs.without_prefix_twins(_chapters(spark, d)).select("bookid", "chapterno")


FAMILY = "lower(regexp_extract({0}, '(?i)^(chapter|habit|part|book)\\s', 1))"


@query(f"""WITH {C.SECTIONS}, {C.GOLD1}, o AS (SELECT DISTINCT bookid, {FAMILY.format('s.title')} f FROM (SELECT bookid, unnest(sections) s FROM gold1)), n AS (SELECT bookid, count(*) n FROM (SELECT bookid, {FAMILY.format('s.title')} f FROM (SELECT bookid, unnest(sections) s FROM gold1)) WHERE f NOT IN ('', 'part', 'book') GROUP BY 1)
SELECT s.bookid, CAST(sectionno AS INT) AS chapterno FROM sections s LEFT JOIN n ON n.bookid = s.bookid WHERE coalesce(n.n, 0) < 2 OR EXISTS (SELECT 1 FROM o WHERE o.bookid = s.bookid AND f <> '' AND f = {FAMILY.format('s.title')})""")
def known_families(spark: SparkSession, d: str) -> DataFrame:
    """Predicted sections of the families that the gold sections number."""
    known = _gold(spark, d).select("bookid", F.explode("sections").alias("s")).select("bookid", "s.title")
    return repairs.only_known_families(_chapters(spark, d), known).select("bookid", "chapterno")


# --- rules that a parse keeps ---------------------------------------------------------------------------------------


def _letters(c):
    return F.regexp_replace(c, LETTERS, "")


@query(f"SELECT doc_id, CAST(length(regexp_replace(text, '{LETTERS}', '', 'g')) AS BIGINT) AS letters, md5(regexp_replace(text, '{LETTERS}', '', 'g')) AS digest FROM documents WHERE regexp_matches(text, '[\\p{{L}}\\p{{N}}]')")
def unit_letters(spark: SparkSession, d: str) -> DataFrame:
    """The letters of every document's reading units in their order: those of its text."""
    own = C.document_units(spark, d).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("unitno", "text"))).alias("u"))  # the units of one document
    text = _letters(F.array_join(F.transform("u", lambda x: x["text"]), ""))
    return own.select("doc_id", F.length(text).cast("long").alias("letters"), F.md5(text).alias("digest")).where("letters > 0")


@query(f"SELECT doc_id, CAST(length(regexp_replace(text, '{LETTERS}', '', 'g')) AS BIGINT) AS letters FROM documents WHERE regexp_matches(text, '[\\p{{L}}\\p{{N}}]')")
def sentence_letters(spark: SparkSession, d: str) -> DataFrame:
    """The letters that the sentences of every document hold: as many as its text."""
    return C.QUERIES["sentence_spans"](spark, d).groupBy("doc_id").agg(F.sum(F.length(_letters(F.col("sentence")))).cast("long").alias("letters")).where("letters > 0")


@query(f"""WITH {C.ONE_PAGE}, l AS (SELECT bookid, pageindex, unnest(regexp_split_to_array(coalesce(text, ''), '\\r?\\n')) t, generate_subscripts(regexp_split_to_array(coalesce(text, ''), '\\r?\\n'), 1) - 1 i, len(regexp_split_to_array(coalesce(text, ''), '\\r?\\n')) n, CASE WHEN height > 0 AND NOT isnan(height) THEN height ELSE 792.0 END h FROM pages1),
p AS (SELECT *, coalesce(sum(length(t) + 1) OVER (PARTITION BY bookid, pageindex ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) s FROM l)
SELECT bookid, pageindex, CAST(i AS INT) AS lineindex, CAST(row_number() OVER (PARTITION BY bookid, pageindex ORDER BY i) - 1 AS INT) AS lineno, CAST(s AS INT) AS sourcestart, CAST(s + length(t) AS INT) AS sourceend, round(64.0 + least(16.0, (h - 64) / n) * i, 6)::DOUBLE AS y, least(504.0, length(t) * 7.0)::DOUBLE AS width FROM p WHERE regexp_matches(t, '[^\\t\\n\\x0b\\f\\r ]')""")
def text_lines(spark: SparkSession, d: str) -> DataFrame:
    """Every page as if it had no spans: its lines on a grid."""
    own = layout.text_lines(C.page_pages(spark, d))
    return own.select("bookid", "pageindex", "lineindex", "lineno", "sourcestart", "sourceend", F.round("y", 6).alias("y"), F.round("width", 6).alias("width"))


@query(f"""WITH {C.ONE_PAGE}, p AS (SELECT bookid, pageindex, coalesce(text, '') t, CASE WHEN width > 0 AND NOT isnan(width) THEN width ELSE 612.0 END w, CASE WHEN height > 0 AND NOT isnan(height) THEN height ELSE 792.0 END h FROM pages1),
s AS (SELECT bookid, pageindex, spanindex, min(text) t, min(bounds) b FROM text_span WHERE regexp_matches(text, '[^\\t\\n\\x0b\\f\\r ]') GROUP BY 1, 2, 3),
g AS (SELECT p.bookid, p.pageindex, s.t FROM s JOIN p ON p.bookid = s.bookid AND p.pageindex = s.pageindex WHERE b.x + b.width > 0 AND b.x < w AND b.y + b.height > 0 AND b.y < h),
a AS (SELECT * FROM g UNION ALL SELECT bookid, pageindex, t FROM p WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.bookid = p.bookid AND s.pageindex = p.pageindex))
SELECT bookid, pageindex, CAST(sum(length(regexp_replace(t, '{LETTERS}', '', 'g'))) AS BIGINT) AS letters FROM a GROUP BY 1, 2 HAVING sum(length(regexp_replace(t, '{LETTERS}', '', 'g'))) > 0""")
def line_letters(spark: SparkSession, d: str) -> DataFrame:
    """The letters that the lines of every page hold: as many as its spans, or its text where it has none."""
    return C.QUERIES["page_lines"](spark, d).groupBy("bookid", "pageindex").agg(F.sum(F.length(_letters(F.col("text")))).cast("long").alias("letters")).where("letters > 0")


@query("SELECT DISTINCT bookid, CAST(0 AS BIGINT) AS n_numbers_off, CAST(0 AS BIGINT) AS n_empty, CAST(0 AS BIGINT) AS n_sections_back, CAST(0 AS BIGINT) AS n_counts_off FROM page_extraction")
def unit_rules(spark: SparkSession, d: str) -> DataFrame:
    """What is wrong with the reading units of every book's parse: numbers that leave gaps, empty texts, sections out of order, word counts that are not the text's."""
    own = C.QUERIES["book_units"](spark, d)
    per = own.groupBy("bookid").agg(
        (F.max("unitno") + 1 - F.count_distinct("unitno")).cast("long").alias("n_numbers_off"), F.count_if(F.coalesce(F.trim("text"), F.lit("")) == "").alias("n_empty"), F.count_if(T.count_words(F.col("text")) != F.col("wordcount")).alias("n_counts_off"),
    )
    firsts = own.groupBy("bookid", "sectionno").agg(F.min("unitno").alias("a"), F.max("unitno").alias("b"))
    order = F.lag("b").over(scans.Window.partitionBy("bookid").orderBy("sectionno"))
    back = firsts.withColumn("back", F.coalesce(order >= F.col("a"), F.lit(False))).groupBy("bookid").agg(F.count_if("back").alias("n_sections_back"))
    books = table(spark, d, "page_extraction").select("bookid").distinct()
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return books.join(per, "bookid", "left").join(back, "bookid", "left").select("bookid", *[zero(c) for c in ("n_numbers_off", "n_empty", "n_sections_back", "n_counts_off")])


@query(f"""WITH {C.OFFSETS}, c AS (SELECT s.bookid, s.title, s.sectionno FROM sections s)
SELECT o.bookid, CAST(o.unitno AS INT) AS unitno, o.page AS pageindex, c.title AS section, o."offset" AS wordsread, o.total AS words, CAST(o.n AS BIGINT) AS units FROM o LEFT JOIN c ON c.bookid = o.bookid AND c.sectionno = o.sectionno""")
def position_summaries(spark: SparkSession, d: str) -> DataFrame:
    """What a library row says of every place: page, section, words read and in all."""
    titles = progress.section_rows(table(spark, d, "prediction")).select("bookid", "sectionno", F.col("title").alias("section"))
    return progress.position_summaries(C._offsets(spark, d), titles)


@query(f"""WITH o AS ({C.SQL['reading_progress']}), b AS (SELECT *, lag(fraction) OVER (PARTITION BY bookid ORDER BY unitno) p FROM o)
SELECT bookid, count(*) AS units, count_if(p > fraction OR fraction < 0 OR fraction > 1) AS unsteady FROM b GROUP BY 1""")
def steadiness(spark: SparkSession, d: str) -> DataFrame:
    """Units of every book, and how many of them break the order of progress."""
    own = progress.progress(C._offsets(spark, d))
    bad = repairs.unsteady_progress(own).groupBy("bookid").agg(F.count("*").alias("unsteady"))
    return own.groupBy("bookid").agg(F.count("*").alias("units")).join(bad, "bookid", "left").select("bookid", "units", F.coalesce("unsteady", F.lit(0)).alias("unsteady"))


@query(f"""WITH {C.ONE_PAGE}, l AS (SELECT bookid, pageindex, unnest(regexp_split_to_array(coalesce(text, ''), '\\r?\\n')) t, generate_subscripts(regexp_split_to_array(coalesce(text, ''), '\\r?\\n'), 1) - 1 i, len(regexp_split_to_array(coalesce(text, ''), '\\r?\\n')) n, CASE WHEN height > 0 AND NOT isnan(height) THEN height ELSE 792.0 END h FROM pages1),
y AS (SELECT bookid, pageindex, {S.clean_line('t')} t, (64.0 + least(16.0, (h - 64) / n) * i)::DOUBLE / greatest(1.0, h) AS rel FROM l WHERE regexp_matches(t, '[^\\t\\n\\x0b\\f\\r ]')),
e AS (SELECT bookid, pageindex, CASE WHEN rel <= 0.14 THEN 'top' ELSE 'bottom' END AS band, {S.furniture_key('t')} AS key FROM y WHERE t <> '' AND NOT (rel > 0.14 AND rel < 0.86) AND NOT (regexp_matches(t, {S.lit(T.PROSE_END)}) AND {S.count_words('t')} > 8))
SELECT bookid, band, key, count(DISTINCT pageindex) AS n_pages FROM e WHERE key <> '' AND length(key) <= 120 GROUP BY 1, 2, 3""")
def margin_keys(spark: SparkSession, d: str) -> DataFrame:
    """Lines in the margins of pages as if these had no spans, by what they look like."""
    pages = C.page_pages(spark, d)
    lines = layout.text_lines(pages).withColumn("text", T.clean_line(F.col("text"))).where("text <> ''")
    return layout.running_clusters(lines, pages).select("bookid", "band", "key", "n_pages")


# --- streams and archives -------------------------------------------------------------------------------------------


@query("SELECT bookid, count(DISTINCT pageindex) AS n_pages, min(ingestedat) AS since FROM page_extraction GROUP BY 1")
def streamed_pages(spark: SparkSession, d: str) -> DataFrame:
    """Page deliveries read as a stream and folded into a table, each page once."""
    source = spark._jvm.org.apache.hadoop.fs.Path(f"{d}/page_extraction.parquet")
    folder = source.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(source).isDirectory()
    schema = table(spark, d, "page_extraction").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").parquet(source.toString()) if folder else None
    if stream is None:
        stream = spark.readStream.schema(schema).option("pathGlobFilter", "page_extraction.parquet").parquet(d)
    at = f"{checkpoint_dir(spark)}/streamed-{uuid.uuid4().hex[:12]}"
    ingest.fold(stream, f"{at}/pages", f"{at}/state").awaitTermination()
    return spark.read.parquet(f"{at}/pages").groupBy("bookid").agg(F.count("*").alias("n_pages"), F.min("ingestedat").alias("since"))


@query(f"SELECT file, headings + paragraphs AS n_blocks, headings + paragraphs AS n_found FROM ({C.SQL['epub_round_trip']})")
def epub_places(spark: SparkSession, d: str) -> DataFrame:
    """Every block of every archive found again in a second reading of it."""
    blocks = epub.book_blocks(epub.read_books(C._packed_documents(spark, d)))
    own = blocks.select(F.col("file").alias("bookid"), "blockno", "path", "sourcestart", F.substring(T.context_key(F.col("text")), 1, 240).alias("contexttext")).withColumn("contexthash", T.context_hash("contexttext"))
    own = cut(own)
    found = progress.remap_in_documents(own.withColumnRenamed("blockno", "anchorid"), own.withColumnRenamed("blockno", "unitno"))
    # One sum over both and no join: the planner takes a row per book for a small table and would broadcast it.
    counted = own.select("bookid", F.lit(True).alias("block"), F.lit(False).alias("hit")).unionByName(found.select("bookid", F.lit(False).alias("block"), (F.col("unitno") == F.col("anchorid")).alias("hit")))
    return counted.groupBy(F.col("bookid").alias("file")).agg(F.count_if(F.col("block")).alias("n_blocks"), F.count_if(F.col("hit")).alias("n_found"))


# --- small functions ------------------------------------------------------------------------------------------------


@query(f"""WITH {C.ONE_RECORD}, n AS (SELECT id, url_decode(replace(regexp_extract(downloadurl, '([^/?#]*)(?:[?#].*)?$', 1), '+', '%2B')) f FROM man1)
SELECT id, f AS file, regexp_replace(f, '\\.[^.]+$', '') AS stem FROM n""")
def file_names(spark: SparkSession, d: str) -> DataFrame:
    """Names of the files that records were downloaded as, with and without their extension."""
    name = T.file_name(F.col("downloadurl"))
    return C.records(spark, d).select("id", name.alias("file"), T.strip_extension(name).alias("stem"))


def _any(kinds: tuple[str, ...]) -> str:
    return ", ".join(S.lit(k) for k in kinds)


@query(f"""WITH {C.SECTIONS} SELECT CASE WHEN kind IN ({_any(T.FRONT_KINDS)}) THEN 'frontMatter' WHEN kind IN ({_any(T.BACK_KINDS)}) THEN 'backMatter' WHEN kind IN ('part', 'section') THEN kind WHEN kind IS NOT NULL THEN 'chapter' END AS navkind, count(*) AS n FROM sections GROUP BY 1""")
def navigation_kinds(spark: SparkSession, d: str) -> DataFrame:
    return progress.section_rows(table(spark, d, "prediction")).groupBy(T.navigation_kind(F.col("kind")).alias("navkind")).agg(F.count("*").alias("n"))


@query(f"WITH {C.ONE_RECORD} SELECT id, greatest(0.0, least(1.0, coalesce(CASE WHEN isnan(textpageratio) THEN NULL ELSE textpageratio END, 0.0)))::DOUBLE AS ratio, CAST(greatest(0, least(500, coalesce(pagecount, 0))) AS INT) AS pages FROM man1")
def clamped_numbers(spark: SparkSession, d: str) -> DataFrame:
    own = C.records(spark, d)
    return own.select("id", T.clamp(F.col("textpageratio"), F.lit(0.0), F.lit(1.0)).alias("ratio"), T.clamp(F.col("pagecount"), F.lit(0), F.lit(500)).cast("int").alias("pages"))


@query("""WITH o AS (SELECT DISTINCT bookid, pageindex, spanindex, lineindex, sourcestart s, sourceend e FROM text_span), l AS (SELECT bookid, pageindex, lineindex, min(s) s, max(e) e FROM o GROUP BY 1, 2, 3), f AS (SELECT bookid, pageindex, min_by(lineindex, (s, e)) i FROM l GROUP BY 1, 2),
u AS (SELECT bookid, pageindex, s, max_by(lineindex, (e, lineindex)) i FROM l GROUP BY 1, 2, 3)
SELECT o.bookid, o.pageindex, o.spanindex, coalesce(u.i, f.i) AS lineindex FROM o ASOF LEFT JOIN u ON o.bookid = u.bookid AND o.pageindex = u.pageindex AND (o.s + o.e) // 2 >= u.s LEFT JOIN f ON f.bookid = o.bookid AND f.pageindex = o.pageindex""")
def span_segments(spark: SparkSession, d: str) -> DataFrame:
    """The line that holds each span's middle, by the lines' ranges."""
    once = table(spark, d, "text_span").select("bookid", "pageindex", "spanindex", "lineindex", F.col("sourcestart").alias("s"), F.col("sourceend").alias("e")).distinct()
    lines = once.groupBy("bookid", "pageindex", "lineindex").agg(F.min("s").alias("start"), F.max("e").alias("end"))
    page = lines.groupBy("bookid", "pageindex").agg(F.array_sort(F.collect_list(F.struct("start", "end", "lineindex"))).alias("segments"))  # the lines of one page
    middle = F.expr("(s + e) div 2").cast("int")
    return once.join(page, ["bookid", "pageindex"]).select("bookid", "pageindex", "spanindex", units.segment_at(F.col("segments"), middle)["lineindex"].alias("lineindex"))


# --- SQL of queries of the catalogue --------------------------------------------------------------------------------

C.SQL["unsteady_progress"] = f"""SELECT * FROM (WITH o AS ({C.SQL['reading_progress']}), b AS (SELECT *, lag(fraction) OVER (PARTITION BY bookid ORDER BY unitno) p FROM o)
SELECT bookid, unitno, fraction, p AS before FROM b WHERE p > fraction OR fraction < 0 OR fraction > 1)"""


def _sql_words(x: str) -> str:
    broken = S.sub(f"nfc_normalize(strip_accents({S.nfkc(x)}))", "(\\p{L})[-‐][\\t\\x0b\\f\\r ]*\\n[\\t\\n\\x0b\\f\\r ]*(\\p{L})", "\\1\\2")
    return f"regexp_extract_all({S.sub(S.sub(f'lower({broken})', '[’' + chr(39) + chr(173) + ']'), '[' + chr(92) + 'p{M}]')}, '[\\p{{L}}\\p{{N}}]+')"


C.SQL["scan_votes"] = f"""WITH {C.ONE_PAGE}, {C.UNITS}, q AS (SELECT bookid, pageindex AS scanid, ({_sql_words("coalesce(text, '')")})[1:400] w FROM pages1 WHERE pageindex % 50 = 0),
a AS (SELECT bookid, scanid, i, w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] g FROM (SELECT *, unnest(range(0, len(w) - 2)) i FROM q WHERE len(w) >= 16 AND len(list_distinct(w)) >= 10)),
u AS (SELECT bookid, unitno, unnest(w) word, generate_subscripts(w, 1) k FROM (SELECT bookid, unitno, {_sql_words("coalesce(u.text, '')")} w FROM units)),
p AS (SELECT bookid, word, row_number() OVER (PARTITION BY bookid ORDER BY unitno, k) - 1 AS pos FROM u), t AS (SELECT bookid, pos, word || ' ' || lead(word, 1) OVER o || ' ' || lead(word, 2) OVER o AS g FROM p WINDOW o AS (PARTITION BY bookid ORDER BY pos)),
r AS (SELECT bookid, g FROM t WHERE g IS NOT NULL GROUP BY 1, 2 HAVING count(*) <= 80)
SELECT a.bookid, a.scanid, CAST(floor((t.pos - a.i) / 32) AS BIGINT) AS bucket, count(*) AS n FROM a JOIN r ON r.bookid = a.bookid AND r.g = a.g JOIN t ON t.bookid = a.bookid AND t.g = a.g GROUP BY 1, 2, 3 HAVING count(*) >= 2"""
