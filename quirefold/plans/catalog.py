"""Every query over the reading operators, and the SQL that gives the same rows where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirefold.functions import text as T
from quirefold.operators import curation, layout, match, metadata, navigation, progress, repairs, scans, scorecard, units
from quirefold.plans import sqltext as S
from quirefold.session import cut, table
from quirefold.sources import epub

PAGE = 46  # lines of a text-only page

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# Rows that several statements share.
ONE_PAGE = "pages1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY bookid, pageindex ORDER BY ingestedat NULLS LAST) n FROM page_extraction) WHERE n = 1)"
LINES = f"{ONE_PAGE}, lines AS (SELECT bookid, pageindex, label, unnest(string_split(text, chr(10))) line, generate_subscripts(string_split(text, chr(10)), 1) - 1 lineindex FROM pages1 WHERE text IS NOT NULL)"
ONE_PREDICTION = "pred1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY bookid ORDER BY parserversion DESC, ingestedat NULLS LAST) n FROM prediction) WHERE n = 1)"
UNITS = f"{ONE_PREDICTION}, units AS (SELECT bookid, coalesce(readingstart, 0) readingstart, unnest(readingunits) u, generate_subscripts(readingunits, 1) - 1 unitno FROM pred1)"
SECTIONS = f"{ONE_PREDICTION}, sections AS (SELECT bookid, s.kind kind, s.title title, coalesce(s.startpage, 0) startpage, sectionno FROM (SELECT bookid, unnest(sections) s, generate_subscripts(sections, 1) - 1 sectionno FROM pred1))"
ONE_RECORD = "man1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ingestedat) n FROM manifest) WHERE n = 1)"


def page_text_lines(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "page_extraction")
    once = scorecard.newest(pages.withColumn("_k", F.struct("bookid", "pageindex")), "_k", [F.asc_nulls_last("ingestedat")]).drop("_k")
    return once.where(F.col("text").isNotNull()).select("bookid", "pageindex", "label", F.posexplode(F.split("text", "\n")).alias("lineindex", "line"))


def records(spark: SparkSession, d: str) -> DataFrame:
    return scorecard.newest(table(spark, d, "manifest"), "id", [F.asc("ingestedat")])


# --- text -----------------------------------------------------------------------------------------------------------


@query(f"""
WITH l AS (SELECT doc_id, unnest(regexp_split_to_array(text, '\\r?\\n')) line, generate_subscripts(regexp_split_to_array(text, '\\r?\\n'), 1) - 1 no FROM documents WHERE text IS NOT NULL)
SELECT doc_id, no AS line_no, no // {PAGE} AS page, no % {PAGE} AS line_index, CAST(coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS source_start,
       {S.clean_line('line')} AS line FROM l""")
def doc_lines(spark: SparkSession, d: str) -> DataFrame:
    """Documents as pages of 46 lines with the place of each line in the text."""
    lines = table(spark, d, "documents").where(F.col("text").isNotNull()).select("doc_id", F.posexplode(F.split("text", "\\r?\\n")).alias("no", "line"))
    placed = scans.running_sum(lines.withColumn("_len", (F.length("line") + 1).cast("long")), ["doc_id"], "no", "_len", "source_start")
    return placed.select("doc_id", F.col("no").cast("long").alias("line_no"), F.expr(f"no div {PAGE}").alias("page"), (F.col("no") % PAGE).cast("long").alias("line_index"), F.col("source_start").cast("long").alias("source_start"), T.clean_line(F.col("line")).alias("line"))


@query(f"WITH {ONE_RECORD} SELECT id, {S.key('title')} AS layout_key, {S.word_key('title')} AS catalog_key, {S.count_words('title')} AS words FROM man1")
def title_keys(spark: SparkSession, d: str) -> DataFrame:
    return records(spark, d).select("id", T.key(F.col("title")).alias("layout_key"), T.word_key(F.col("title")).alias("catalog_key"), T.count_words(F.col("title")).cast("long").alias("words"))


@query(f"WITH {LINES} SELECT bookid, {S.furniture_key('line')} AS key, count(*) AS n_lines, count(DISTINCT pageindex) AS n_pages FROM lines GROUP BY 1, 2")
def furniture_keys(spark: SparkSession, d: str) -> DataFrame:
    return page_text_lines(spark, d).groupBy("bookid", T.furniture_key(F.col("line")).alias("key")).agg(F.count("*").alias("n_lines"), F.count_distinct("pageindex").alias("n_pages"))


@query(f"""WITH {LINES}, k AS (SELECT {S.title_kind('line')} k, line FROM lines WHERE {S.squeeze('line')} <> '')
SELECT coalesce(split_part(k, ' ', 1), 'none') AS kind, coalesce(CAST(split_part(k, ' ', 2) AS INT), -1) AS level, count(*) AS n, count(DISTINCT line) AS n_distinct FROM k GROUP BY 1, 2""")
def title_kinds(spark: SparkSession, d: str) -> DataFrame:
    """What section kinds the lines of pages name."""
    k = page_text_lines(spark, d).where(T.squeeze(F.col("line")) != "").select("line", T.title_kind(F.col("line")).alias("k"))
    return k.groupBy(F.coalesce("k.kind", F.lit("none")).alias("kind"), F.coalesce("k.level", F.lit(-1)).alias("level")).agg(F.count("*").alias("n"), F.count_distinct("line").alias("n_distinct"))


@query(f"""WITH {LINES} SELECT bookid, pageindex, count(*) AS n_lines,
  CAST(sum(CASE WHEN regexp_matches({S.clean_line('line')}, '^(?:page\\s+)?(?:\\d{{1,5}}|[ivxlcdm]{{1,12}})(?:\\s+(?:of|/)\\s+\\d{{1,5}})?$', 'i') THEN 1 ELSE 0 END) AS BIGINT) AS page_numbers,
  CAST(sum(CASE WHEN len(regexp_extract_all(line, '{S.WS}{{2,}}')) >= 2 OR len(regexp_extract_all(line, '\\|')) >= 2 OR regexp_matches(line, '^(?:[^\\s]+\\s+){{0,2}}\\d+(?:[.,]\\d+)?(?:\\s+\\d+(?:[.,]\\d+)?){{2,}}$') THEN 1 ELSE 0 END) AS BIGINT) AS tabular,
  CAST(sum({S.count_words('line')}) AS BIGINT) AS words FROM lines GROUP BY 1, 2""")
def page_line_flags(spark: SparkSession, d: str) -> DataFrame:
    one = lambda c: F.sum(c.cast("long"))
    line = F.col("line")
    return page_text_lines(spark, d).groupBy("bookid", "pageindex").agg(F.count("*").alias("n_lines"), one(T.is_page_number(line)).alias("page_numbers"), one(T.looks_tabular(line)).alias("tabular"), F.sum(T.count_words(line)).cast("long").alias("words"))


@query(f"""WITH {ONE_RECORD}, t AS (SELECT id, {S.clean_line('title')} t FROM man1)
SELECT id, (length(t) BETWEEN 3 AND 180 AND NOT regexp_matches(t, '^(?:untitled|unknown|document|ebook|book)$', 'i') AND NOT regexp_matches(t, '^(?:copyright|contents|table of contents|isbn|published by|chapter|part)\\b', 'i')
  AND NOT regexp_matches(t, '\\.(?:pdf|indd|docx?|ps|eps)$|^(?:microsoft word|untitled[-\\s\\d]|\\d{{5,}}[_-])', 'i') AND len(string_split(t, ' ')) <= 28 AND NOT regexp_matches(t, '\\.\\s|\\.$')) AS plausible,
  regexp_replace(regexp_replace(t, '\\s+[.·…]{{2,}}\\s*\\d+\\s*$', ''), '[\\s:;,.]+$', '') AS heading FROM t""")
def title_checks(spark: SparkSession, d: str) -> DataFrame:
    return records(spark, d).select("id", T.is_plausible_title(F.col("title")).alias("plausible"), T.clean_heading(F.col("title")).alias("heading"))


HASH = "lpad(lower(to_hex(list_reduce(list_prepend(CAST(2166136261 AS UBIGINT), list_transform(string_split(k, ''), lambda c: CAST(unicode(c) AS UBIGINT))), lambda h, c: (xor(h, c) * 16777619) % 4294967296))), 8, '0')"


@query(f"""WITH {UNITS}, k AS (SELECT bookid, unitno, substr({S.context_key('u.text')}, 1, 240) k FROM units WHERE u.text IS NOT NULL)
SELECT bookid, CAST(unitno AS BIGINT) AS unitno, k AS context, CASE WHEN k = '' THEN '811c9dc5' ELSE {HASH} END AS hash FROM k""")
def context_hashes(spark: SparkSession, d: str) -> DataFrame:
    """The context by which a position is found again in another parse."""
    own = progress.unit_rows(table(spark, d, "prediction")).where(F.col("text").isNotNull()).select("bookid", F.col("unitno").cast("long").alias("unitno"), F.substring(T.context_key(F.col("text")), 1, 240).alias("context"))
    return own.withColumn("hash", T.context_hash("context"))


GOLD1 = "gold1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY bookid ORDER BY ingestedat NULLS LAST) n FROM annotation) WHERE n = 1)"


def _dice(a: str, b: str) -> str:
    return f"2.0 * len(list_intersect({a}, {b})) / (len({a}) + len({b}))"


@query(f"""WITH {GOLD1}, {ONE_RECORD}, t AS (SELECT bookid, {S.key('g.title')} a, {S.key('m.title')} b, {S.word_key('g.title')} c, {S.word_key('m.title')} e FROM gold1 g JOIN man1 m ON m.id = g.bookid),
w AS (SELECT *, list_distinct(string_split(a, ' ')) aw, list_distinct(string_split(b, ' ')) bw, list_distinct(string_split(c, ' ')) cw, list_distinct(string_split(e, ' ')) ew FROM t)
SELECT bookid, round(CASE WHEN a = '' OR b = '' OR a IS NULL OR b IS NULL THEN 0 WHEN a = b THEN 1 WHEN contains(a, b) OR contains(b, a) THEN least(length(a), length(b)) / greatest(length(a), length(b)) ELSE {_dice('aw', 'bw')} END, 6) AS layout_similarity,
  round(CASE WHEN c = '' OR e = '' OR c IS NULL OR e IS NULL THEN 0 ELSE {_dice('cw', 'ew')} END, 6) AS word_similarity FROM w""")
def title_similarity(spark: SparkSession, d: str) -> DataFrame:
    gold = scorecard.newest(table(spark, d, "annotation"), "bookid", [F.asc_nulls_last("ingestedat")]).select("bookid", F.col("title").alias("a"))
    both = gold.join(records(spark, d).select(F.col("id").alias("bookid"), F.col("title").alias("b")), "bookid")
    return both.select("bookid", F.round(T.title_similarity(F.col("a"), F.col("b")), 6).alias("layout_similarity"), F.round(T.word_similarity(F.col("a"), F.col("b")), 6).alias("word_similarity"))


# --- catalogue ------------------------------------------------------------------------------------------------------


@query()
def record_marks(spark: SparkSession, d: str) -> DataFrame:
    """Length tier, second review and the identifier made from what a record says."""
    c = F.col
    return records(spark, d).select("id", T.page_tier(c("pagecount")).alias("tier"), T.needs_second_review(c("id"), c("split")).alias("review"), T.stable_id(c("source"), c("doi"), c("title"), c("publisher")).alias("stable"))


SQL["record_marks"] = f"""WITH {ONE_RECORD}, k AS (SELECT *, [CASE WHEN coalesce(source, '') <> '' THEN {S.word_key('source')} END, CASE WHEN coalesce(doi, '') <> '' THEN {S.word_key('doi')} END,
  CASE WHEN coalesce(title, '') <> '' THEN {S.word_key('title')} END, CASE WHEN coalesce(publisher, '') <> '' THEN {S.word_key('publisher')} END] ks FROM man1)
SELECT id, CASE WHEN pagecount < 150 THEN 'short' WHEN pagecount <= 350 THEN 'medium' WHEN pagecount IS NOT NULL THEN 'long' END AS tier,
  coalesce(split IN ('development', 'locked-test') AND CAST('0x' || substr(id, 1, 8) AS BIGINT) % 5 = 0, false) AS review,
  substr(sha256(array_to_string(list_filter(ks, lambda x: x IS NOT NULL), chr(31))), 1, 20) AS stable FROM k"""


@query("SELECT sha256, min(id) AS id FROM manifest WHERE sha256 IS NOT NULL GROUP BY sha256")
def checksum_dedupe(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "manifest").where(F.col("sha256").isNotNull()).select("sha256", "id")
    return curation.first_by(own, ["sha256"], [F.col("id")])


@query("SELECT text, min(doc_id) AS doc_id FROM documents GROUP BY text")
def text_dedupe(spark: SparkSession, d: str) -> DataFrame:
    return curation.first_by(table(spark, d, "documents").select("doc_id", "text"), ["text"], [F.col("doc_id")])


@query()
def catalogue_dedupe(spark: SparkSession, d: str) -> DataFrame:
    own = records(spark, d)
    return curation.dedupe_records(own.select("id", "doi", "isbns", "title", "publisher"), "id").select("id")


@query("""WITH once AS (SELECT DISTINCT id, sha256, title, downloadurl FROM manifest)
SELECT 'id' AS rule, id AS value, count(*) AS n FROM once GROUP BY id HAVING count(*) > 1 UNION ALL SELECT 'checksum', sha256, count(DISTINCT id) FROM once WHERE sha256 IS NOT NULL GROUP BY sha256 HAVING count(DISTINCT id) > 1""")
def record_violations(spark: SparkSession, d: str) -> DataFrame:
    return curation.record_violations(table(spark, d, "manifest"))


@query(f"""WITH {ONE_RECORD}, p AS (SELECT id, row_number() OVER (ORDER BY id) place FROM man1), s AS (SELECT id, place, CASE WHEN place <= 150 THEN 'discovery' WHEN place <= 200 THEN 'development' WHEN place <= 300 THEN 'locked-test' ELSE 'discovery' END s FROM p)
SELECT id, place, s AS newsplit, s IN ('development', 'locked-test') AND CAST('0x' || substr(id, 1, 8) AS BIGINT) % 5 = 0 AS needsreview FROM s""")
def quota_splits(spark: SparkSession, d: str) -> DataFrame:
    return curation.quota_splits(records(spark, d).select("id"), [F.asc("id")], 150, 50, 100).select("id", F.col("place").cast("long").alias("place"), "newsplit", "needsreview")


@query()
def varied_sample(spark: SparkSession, d: str) -> DataFrame:
    return curation.varied_sample(records(spark, d), 300)


@query(f"""WITH {ONE_PAGE}, n AS (SELECT bookid, count(*) n, max(pageindex) AS last FROM pages1 GROUP BY 1),
s AS (SELECT DISTINCT bookid, CAST(round_even(i * last / greatest(1, least(11, n) - 1), 0) AS INT) pageindex FROM n, unnest(generate_series(0, least(11, n) - 1)) t(i)),
c AS (SELECT s.bookid, coalesce(length(regexp_replace(p.text, '{S.WS}+', '', 'g')), 0) chars FROM s LEFT JOIN pages1 p ON p.bookid = s.bookid AND p.pageindex = s.pageindex),
g AS (SELECT bookid, count(*) AS n_sampled, round(sum(CASE WHEN chars >= 50 THEN 1 ELSE 0 END) / count(*), 4) AS textratio, round(sum(chars) / count(*), 4) AS meanchars FROM c GROUP BY 1)
SELECT *, textratio >= 0.7 AND meanchars >= 100 AS borndigital FROM g""")
def born_digital(spark: SparkSession, d: str) -> DataFrame:
    return curation.born_digital(table(spark, d, "page_extraction"))


@query(f"""WITH {ONE_RECORD}, p AS (SELECT id, title, downloadedat, catalogedat, row_number() OVER (ORDER BY downloadedat IS NULL, coalesce(downloadedat, catalogedat) DESC, catalogedat DESC, id) place FROM man1)
SELECT id, place FROM p""")
def library_order(spark: SparkSession, d: str) -> DataFrame:
    books = records(spark, d).select("id", F.col("downloadedat").alias("lastread"), F.col("catalogedat").alias("imported"))
    return progress.library_order(books).select("id", F.col("place").cast("long").alias("place"))


@query(f"WITH {ONE_RECORD} SELECT id FROM man1 WHERE contains(lower(coalesce(title, '')), 'lantern') OR contains(lower(coalesce(regexp_extract(localpath, '[^/]*$'), '')), 'lantern')")
def library_search(spark: SparkSession, d: str) -> DataFrame:
    books = records(spark, d).select("id", "title", T.file_name(F.col("localpath")).alias("filename"))
    return progress.library_search(books, "  Lantern ").select("id")


# --- layout ---------------------------------------------------------------------------------------------------------


def _lines(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    pages = layout.pages_of(table(spark, d, "page_extraction"))
    return pages, layout.page_lines(pages, table(spark, d, "text_span"))


def _blocks(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Pages and their blocks."""
    pages, _, found = _lines_and_blocks(spark, d)
    return pages, found


def _lines_and_blocks(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pages, all their lines, and blocks without running lines; the lines are written once, as running lines, sizes and blocks all read them."""
    pages, lines = _lines(spark, d)
    lines = cut(lines)
    kept = layout.without_running(lines, layout.running_clusters(lines, pages))
    return pages, lines, layout.blocks(kept, layout.body_sizes(kept))


@query()
def page_lines(spark: SparkSession, d: str) -> DataFrame:
    return _lines(spark, d)[1]


@query("SELECT bookid, pageindex, lineindex, max(fontsize) AS fontsize FROM text_span GROUP BY 1, 2, 3")
def leading_fonts(spark: SparkSession, d: str) -> DataFrame:
    return layout.leading_fonts(table(spark, d, "text_span"))


@query()
def running_clusters(spark: SparkSession, d: str) -> DataFrame:
    pages, lines = _lines(spark, d)
    return layout.running_clusters(lines, pages)


@query()
def blocks(spark: SparkSession, d: str) -> DataFrame:
    """Blocks of every page after running lines are gone."""
    return _blocks(spark, d)[1]


@query()
def body_sizes(spark: SparkSession, d: str) -> DataFrame:
    return layout.body_sizes(_lines(spark, d)[1])


@query("""WITH once AS (SELECT DISTINCT bookid, pageindex, spanindex, lineindex, sourcestart s, sourceend e FROM text_span), l AS (SELECT bookid, pageindex, lineindex, min(s) s, max(e) e FROM once GROUP BY 1, 2, 3)
SELECT l.bookid, l.pageindex, l.lineindex, count(*) AS n_spans FROM l JOIN once o ON o.bookid = l.bookid AND o.pageindex = l.pageindex AND o.s < l.e AND o.e > l.s GROUP BY 1, 2, 3""")
def span_overlaps(spark: SparkSession, d: str) -> DataFrame:
    """How many spans overlap each line's range of the page's text: an equi-join on the page with the ranges as residue."""
    once = table(spark, d, "text_span").select("bookid", "pageindex", "spanindex", "lineindex", F.col("sourcestart").alias("s"), F.col("sourceend").alias("e")).distinct()
    lines = once.groupBy("bookid", "pageindex", "lineindex").agg(F.min("s").alias("ls"), F.max("e").alias("le"))
    return lines.join(once.select("bookid", "pageindex", "s", "e"), ["bookid", "pageindex"]).where("s < le and e > ls").groupBy("bookid", "pageindex", "lineindex").agg(F.count("*").alias("n_spans"))


# --- sentences and units --------------------------------------------------------------------------------------------


def document_units(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where(F.col("text").isNotNull())
    passage = docs.select("doc_id", T.join_lines(F.split("text", "\\r?\\n")).alias("text"))
    return units.reading_units(units.passage_sentences(passage, ["doc_id"]), ["doc_id"])


@query()
def reading_units(spark: SparkSession, d: str) -> DataFrame:
    return document_units(spark, d)


@query()
def sentence_spans(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where(F.col("text").isNotNull())
    return units.passage_sentences(docs.select("doc_id", T.join_lines(F.split("text", "\\r?\\n")).alias("text")), ["doc_id"])


# --- sections, positions --------------------------------------------------------------------------------------------


@query(f"""WITH {SECTIONS}, {ONE_PAGE}, l AS (SELECT bookid, max(pageindex) AS last FROM pages1 GROUP BY 1)
SELECT s.bookid, CAST(sectionno AS INT) AS sectionno, kind, startpage, greatest(startpage, coalesce(lead(startpage) OVER (PARTITION BY s.bookid ORDER BY startpage, sectionno) - 1, last)) AS endpage FROM sections s LEFT JOIN l ON l.bookid = s.bookid""")
def section_ranges(spark: SparkSession, d: str) -> DataFrame:
    last = table(spark, d, "page_extraction").groupBy("bookid").agg(F.max("pageindex").alias("lastpage"))
    return progress.section_ranges(progress.section_rows(table(spark, d, "prediction")), last).select("bookid", "sectionno", "kind", "startpage", "endpage")


@query(f"""WITH {GOLD1}, s AS (SELECT bookid, s.kind kind, coalesce(s.level, 0) AS lev, sectionno FROM (SELECT bookid, unnest(sections) s, generate_subscripts(sections, 1) - 1 sectionno FROM gold1))
SELECT a.bookid, CAST(a.sectionno AS INT) AS sectionno, a.lev AS level, CAST((SELECT max(b.sectionno) FROM s b WHERE b.bookid = a.bookid AND b.sectionno < a.sectionno AND b.lev < a.lev) AS INT) AS parentno FROM s a""")
def section_parents(spark: SparkSession, d: str) -> DataFrame:
    gold = scorecard.newest(table(spark, d, "annotation"), "bookid", [F.asc_nulls_last("ingestedat")])
    own = gold.select("bookid", F.posexplode("sections").alias("sectionno", "s")).select("bookid", "sectionno", F.coalesce("s.level", F.lit(0)).alias("level"))
    return progress.section_parents(own).select("bookid", "sectionno", "level", "parentno")


@query(f"""WITH {ONE_PAGE}, {SECTIONS}, m AS (SELECT bookid, startpage, max(sectionno) sectionno FROM sections GROUP BY 1, 2)
SELECT p.bookid, p.pageindex, CAST(m.sectionno AS INT) AS sectionno, s.kind AS kind FROM pages1 p ASOF LEFT JOIN m ON p.bookid = m.bookid AND p.pageindex >= m.startpage LEFT JOIN sections s ON s.bookid = m.bookid AND s.sectionno = m.sectionno""")
def page_sections(spark: SparkSession, d: str) -> DataFrame:
    """The section that each page lies in."""
    pages = table(spark, d, "page_extraction").select("bookid", "pageindex").distinct()
    found = progress.units_in_sections(pages, progress.section_rows(table(spark, d, "prediction")))
    return found.select("bookid", "pageindex", "sectionno", F.col("sectionkind").alias("kind"))


@query(f"""WITH {UNITS}, {GOLD1}, u AS (SELECT bookid, u.anchor.pageindex AS page, min(unitno) unitno FROM units WHERE u.anchor.pageindex IS NOT NULL GROUP BY 1, 2),
b AS (SELECT bookid, b.pageindex AS pageindex, blockno FROM (SELECT bookid, unnest(blocks) b, generate_subscripts(blocks, 1) - 1 blockno FROM gold1) WHERE b.pageindex IS NOT NULL)
SELECT b.bookid, CAST(b.blockno AS INT) AS blockno, CAST((SELECT arg_min(u.unitno, (abs(u.page - b.pageindex), u.unitno)) FROM u WHERE u.bookid = b.bookid) AS INT) AS unitno FROM b""")
def nearest_units(spark: SparkSession, d: str) -> DataFrame:
    """The reading unit nearest to each gold block by page."""
    u = progress.unit_rows(table(spark, d, "prediction")).where(F.col("pageindex").isNotNull()).select("bookid", "pageindex", "unitno")
    gold = scorecard.newest(table(spark, d, "annotation"), "bookid", [F.asc_nulls_last("ingestedat")])
    b = gold.select("bookid", F.posexplode("blocks").alias("blockno", "b")).select("bookid", "blockno", F.col("b.pageindex").alias("pageindex")).where(F.col("pageindex").isNotNull())
    return scans.nearest(b, u, ["bookid"], "pageindex", "unitno").select("bookid", "blockno", "unitno")


OFFSETS = f"""{UNITS}, {SECTIONS.split('), ', 1)[1]}, m AS (SELECT bookid, startpage, max(sectionno) sectionno FROM sections GROUP BY 1, 2),
us AS (SELECT q.*, s.kind FROM (SELECT x.*, m.sectionno FROM (SELECT bookid, readingstart, unitno, u.text AS text, u.anchor.pageindex AS page FROM units) x ASOF LEFT JOIN m ON x.bookid = m.bookid AND x.page >= m.startpage) q LEFT JOIN sections s ON s.bookid = q.bookid AND s.sectionno = q.sectionno),
w AS (SELECT *, CAST(CASE WHEN unitno >= readingstart AND coalesce(kind NOT IN ({', '.join(S.lit(k) for k in T.UNCOUNTED_KINDS)}), true) THEN coalesce({S.count_words('text')}, 0) ELSE 0 END AS BIGINT) words FROM us),
o AS (SELECT *, CAST(sum(words) OVER (PARTITION BY bookid ORDER BY unitno) - words AS BIGINT) AS "offset", CAST(sum(words) OVER (PARTITION BY bookid) AS BIGINT) total, count(*) OVER (PARTITION BY bookid) n FROM w)"""


def _offsets(spark: SparkSession, d: str) -> DataFrame:
    predictions = table(spark, d, "prediction")
    return progress.word_offsets(progress.units_in_sections(progress.unit_rows(predictions), progress.section_rows(predictions)))


@query(f'WITH {OFFSETS} SELECT bookid, CAST(unitno AS INT) AS unitno, words, "offset", total FROM o')
def word_offsets(spark: SparkSession, d: str) -> DataFrame:
    return _offsets(spark, d).select("bookid", "unitno", "words", "offset", "total")


FRACTION = "CASE WHEN n > 1 AND unitno = n - 1 AND unitno > least(readingstart, n - 1) THEN 1.0 WHEN total > 0 THEN \"offset\" / total ELSE 0.0 END"


@query(f"""WITH {OFFSETS} SELECT bookid, CAST(unitno AS INT) AS unitno, round({FRACTION}, 6) AS fraction,
  CASE WHEN unitno <= readingstart THEN 'Not started' WHEN {FRACTION} >= 1 THEN 'Finished' ELSE CAST(least(99, CAST(floor({FRACTION} * 100 + 0.5) AS BIGINT)) AS VARCHAR) || '% read' END AS label FROM o""")
def reading_progress(spark: SparkSession, d: str) -> DataFrame:
    offsets = _offsets(spark, d)
    found = progress.progress(offsets).join(offsets.select("bookid", "unitno", "readingstart"), ["bookid", "unitno"])
    return found.select("bookid", "unitno", F.round("fraction", 6).alias("fraction"), progress.shown_progress(F.col("fraction"), F.col("unitno"), F.col("readingstart")).alias("label"))


@query(f"""WITH {OFFSETS}, c AS (SELECT s.bookid, s.kind, (SELECT min(x.unitno) FROM o x WHERE x.bookid = s.bookid AND x.page >= s.startpage) unitno FROM sections s WHERE s.kind = 'chapter'),
f AS (SELECT DISTINCT o.bookid, round("offset" / total, 6) f FROM c JOIN o ON o.bookid = c.bookid AND o.unitno = c.unitno WHERE o.unitno >= readingstart AND total > 0 AND "offset" < total)
SELECT bookid, f AS mark FROM f UNION SELECT bookid, 0.0 FROM f UNION SELECT bookid, 1.0 FROM f""")
def chapter_marks(spark: SparkSession, d: str) -> DataFrame:
    """Where chapters begin as shares of the book's words."""
    offsets = _offsets(spark, d)
    chapters = progress.section_rows(table(spark, d, "prediction")).where("kind = 'chapter'")
    ahead = offsets.where(F.col("pageindex").isNotNull()).select("bookid", (-F.col("pageindex")).alias("minus"), F.struct((-F.col("unitno")).alias("u")).alias("_first"))
    starts = scans.backward_asof(chapters.select("bookid", (-F.col("startpage")).alias("minus"), "kind", "sectionno"), ahead, ["bookid"], "minus", "_first")
    # The first unit on or after the start: units are in page order, so that is the smallest one of the first page reached.
    found = starts.select("bookid", "kind", (-F.col("_first.u")).alias("unitno")).where(F.col("unitno").isNotNull())
    return progress.chapter_marks(offsets, found).select("bookid", F.explode("marks").alias("mark")).select("bookid", F.round("mark", 6).alias("mark")).distinct()


# --- matching -------------------------------------------------------------------------------------------------------


def _scans(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Query set: the pages whose index is divisible by 50, each against all units of its book."""
    predictions = table(spark, d, "prediction")
    pages = page_pages(spark, d).where(F.col("pageindex") % 50 == 0)
    return pages.select("bookid", F.col("pageindex").alias("scanid"), "text"), progress.unit_rows(predictions).select("bookid", "unitno", "text")


def page_pages(spark: SparkSession, d: str) -> DataFrame:
    return layout.pages_of(table(spark, d, "page_extraction"))


@query()
def scan_votes(spark: SparkSession, d: str) -> DataFrame:
    scans_, own = _scans(spark, d)
    return match.votes(match.scan_queries(scans_), match.placed_words(own)).select("bookid", "scanid", "bucket", "n")


@query()
def scan_matches(spark: SparkSession, d: str) -> DataFrame:
    return match.match_scans(*_scans(spark, d))


@query()
def position_remap(spark: SparkSession, d: str) -> DataFrame:
    """Places of the gold blocks found again among the predicted units."""
    gold = scorecard.newest(table(spark, d, "annotation"), "bookid", [F.asc_nulls_last("ingestedat")])
    old = gold.select("bookid", F.posexplode("blocks").alias("anchorid", "b")).where("b.text is not null and b.pageindex is not null")
    old = old.select("bookid", "anchorid", F.substring(T.context_key(F.col("b.text")), 1, 240).alias("contexttext"), F.col("b.pageindex").alias("pageindex"), F.lit(0).alias("sourcestart")).withColumn("contexthash", T.context_hash("contexttext"))
    new = progress.unit_rows(table(spark, d, "prediction")).where("text is not null and pageindex is not null")
    new = new.select("bookid", "unitno", F.substring(T.context_key(F.col("text")), 1, 240).alias("contexttext"), "pageindex", F.lit(0).alias("sourcestart"), F.array("pageindex").alias("sourcepages")).withColumn("contexthash", T.context_hash("contexttext"))
    return progress.remap(old, new).select("bookid", "anchorid", "unitno", F.round("confidence", 6).alias("confidence"), "how")


# --- scorecard ------------------------------------------------------------------------------------------------------

WORDS = S.count_words("coalesce(u.text, '')")


@query(f"""WITH {GOLD1}, {ONE_PREDICTION}, j AS (SELECT g.bookid, g.title gt, p.metadata.title.value pt, g.readingstartpage rp, coalesce(p.readingstart, 0) rs, p.readingunits ru, g.bodywordcount bw, list_distinct(coalesce(g.runningfurniture, [])) rf,
  list_distinct(coalesce(g.sentenceends, [])) ge, list_distinct(coalesce(p.sentenceends, [])) pe FROM gold1 g JOIN pred1 p ON p.bookid = g.bookid),
uu AS (SELECT bookid, CAST(sum(coalesce(u.wordcount, {WORDS})) AS BIGINT) words, {S.word_key("string_agg(coalesce(u.text, ''), ' ' ORDER BY no)")} txt FROM (SELECT bookid, unnest(ru) u, generate_subscripts(ru, 1) no FROM j) GROUP BY 1),
fu AS (SELECT DISTINCT bookid, {S.word_key('f')} k FROM (SELECT bookid, unnest(rf) f FROM j)), lk AS (SELECT fu.bookid, CAST(sum(len(string_split(k, ' '))) AS BIGINT) leaked FROM fu JOIN uu ON uu.bookid = fu.bookid WHERE k <> '' AND contains(txt, k) GROUP BY 1),
s AS (SELECT j.*, coalesce(uu.words, 0) words, coalesce(leaked, 0) leaked, len(ge) g, len(pe) p, len(list_intersect(ge, pe)) b FROM j LEFT JOIN uu ON uu.bookid = j.bookid LEFT JOIN lk ON lk.bookid = j.bookid),
r AS (SELECT *, CASE WHEN p > 0 THEN b / p WHEN g = 0 THEN 1.0 ELSE 0.0 END pr, CASE WHEN g > 0 THEN b / g WHEN p = 0 THEN 1.0 ELSE 0.0 END re FROM s)
SELECT bookid, CAST({S.word_key("coalesce(gt, '')")} = {S.word_key("coalesce(pt, '')")} AS DOUBLE) AS titleaccuracy, CAST(abs(CASE WHEN rs >= 0 THEN coalesce(ru[rs + 1].anchor.pageindex, 0) ELSE 0 END - coalesce(rp, 0)) <= 1 AS DOUBLE) AS startnear,
  round(CASE WHEN bw > 0 THEN least(1.0, words / bw) ELSE 1.0 END, 6) AS retention, round(leaked / greatest(1, words), 6) AS leakage, round(pr, 6) AS sentenceprecision, round(re, 6) AS sentencerecall,
  round(CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0.0 END, 6) AS sentencef1 FROM r""")
def book_scores(spark: SparkSession, d: str) -> DataFrame:
    return scorecard.book_scores(table(spark, d, "annotation"), table(spark, d, "prediction"))


@query()
def section_scores(spark: SparkSession, d: str) -> DataFrame:
    return scorecard.book_section_scores(table(spark, d, "annotation"), table(spark, d, "prediction"))


@query()
def corpus_scores(spark: SparkSession, d: str) -> DataFrame:
    gold, predictions = table(spark, d, "annotation"), table(spark, d, "prediction")
    return scorecard.corpus_scores(scorecard.book_scores(gold, predictions), scorecard.book_section_scores(gold, predictions))


@query("""WITH m AS (SELECT id, max(publisher) publisher, max(subjects) subjects, max(hasoutline) hasoutline FROM manifest GROUP BY id), c AS (SELECT bookid, count(DISTINCT pageindex) pages FROM page_extraction GROUP BY 1),
b AS (SELECT * FROM m JOIN c ON c.bookid = m.id)
SELECT count(*) AS documents, count(DISTINCT CASE WHEN publisher <> '' THEN publisher END) AS publishers, (SELECT count(DISTINCT s) FROM (SELECT unnest(subjects) s FROM b)) AS subjects, min(pages) AS minpages, median(pages) AS medianpages, max(pages) AS maxpages,
  round(avg(CASE WHEN coalesce(hasoutline, false) THEN 1.0 ELSE 0.0 END), 4) AS outlineshare FROM b""")
def corpus_summary(spark: SparkSession, d: str) -> DataFrame:
    return scorecard.corpus_summary(table(spark, d, "manifest"), table(spark, d, "page_extraction"), table(spark, d, "prediction"))


@query(f"""WITH {ONE_PREDICTION}, s AS (SELECT bookid, coalesce(s.kind, 'unknown') kind, pos FROM (SELECT bookid, unnest(sections) s, generate_subscripts(sections, 1) pos FROM pred1)), g AS (SELECT kind, count(*) n, min((bookid, pos)) f FROM s GROUP BY 1)
SELECT kind, n, CAST(row_number() OVER (ORDER BY n DESC, f) AS INT) AS place FROM g""")
def kind_histogram(spark: SparkSession, d: str) -> DataFrame:
    return scorecard.kind_histogram(table(spark, d, "prediction"))


@query("SELECT bookid, round_even(median(fontsize), 3) AS medianfontsize FROM (SELECT DISTINCT bookid, pageindex, spanindex, fontsize FROM text_span WHERE fontsize > 0) GROUP BY 1")
def font_medians(spark: SparkSession, d: str) -> DataFrame:
    return scorecard.font_medians(table(spark, d, "text_span"))


@query(f"""WITH {UNITS}, o AS (SELECT bookid, pageindex, max(coalesce(text, '')) t FROM page_extraction GROUP BY 1, 2), s AS (SELECT bookid, count(*) pages, CAST(sum(len(regexp_extract_all(t, '[\\p{{L}}\\p{{N}}_]+'))) AS BIGINT) sw FROM o GROUP BY 1),
r AS (SELECT bookid, CAST(sum(len(regexp_extract_all(coalesce(u.text, ''), '[\\p{{L}}\\p{{N}}_]+'))) AS BIGINT) rw, count(*) n, CAST(sum(CASE WHEN u.wordcount > 250 THEN 1 WHEN u.wordcount IS NOT NULL THEN 0 END) AS BIGINT) big, max(u.wordcount) mx FROM units GROUP BY 1)
SELECT s.bookid, pages, sw AS sourcewords, rw AS readingwords, round_even(rw / greatest(1, sw), 4) AS ratio, n AS units, coalesce(big, 0) AS oversized, coalesce(mx, 0) AS maxwords FROM s JOIN r ON r.bookid = s.bookid""")
def book_audit(spark: SparkSession, d: str) -> DataFrame:
    return scorecard.book_audit(table(spark, d, "page_extraction"), progress.unit_rows(table(spark, d, "prediction")))


# --- navigation and metadata ----------------------------------------------------------------------------------------


def _evidence(spark: SparkSession, d: str) -> DataFrame:
    return navigation.page_evidence(page_pages(spark, d), layout.leading_fonts(table(spark, d, "text_span")))


@query(f"""WITH {ONE_PAGE}, l AS (SELECT bookid, pageindex, unnest(string_split(coalesce(text, ''), chr(10))) raw, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) no FROM pages1),
c AS (SELECT *, {S.squeeze('raw')} t FROM l), f AS (SELECT *, row_number() OVER (PARTITION BY bookid, pageindex ORDER BY no) r FROM c WHERE t <> ''),
a AS (SELECT bookid, pageindex, sum(CASE WHEN r <= 4 AND regexp_matches(t, '^(table of )?contents$', 'i') THEN 1 ELSE 0 END) lab, sum(CASE WHEN regexp_matches(t, '^\\d{{1,4}}$') THEN 1 ELSE 0 END) nums, sum(CASE WHEN regexp_matches(t, '^part\\s+[IVX\\d]+\\b', 'i') THEN 1 ELSE 0 END) parts FROM f GROUP BY 1, 2),
d AS (SELECT bookid, pageindex, sum(CASE WHEN regexp_matches(raw, '[.�·]{{3,}}\\s*\\d{{1,4}}[.]?\\s*$') THEN 1 ELSE 0 END) leads FROM l GROUP BY 1, 2)
SELECT d.bookid, d.pageindex, coalesce(lab, 0) > 0 OR leads >= 4 OR (coalesce(nums, 0) >= 6 AND coalesce(parts, 0) >= 2) AS istable FROM d LEFT JOIN a ON a.bookid = d.bookid AND a.pageindex = d.pageindex""")
def contents_pages(spark: SparkSession, d: str) -> DataFrame:
    return _evidence(spark, d).select("bookid", "pageindex", "istable")


@query()
def source_chapters(spark: SparkSession, d: str) -> DataFrame:
    return navigation.source_chapters(_evidence(spark, d))


def _sections(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Blocks, written once, and the sections of their books."""
    pages, found = _blocks(spark, d)
    evidence, found = cut(_evidence(spark, d)), cut(found)
    titles = records(spark, d).select(F.col("id").alias("bookid"), "title").join(pages.select("bookid").distinct(), "bookid", "left_semi")
    return found, navigation.sections(found, evidence, navigation.source_chapters(evidence), pages, titles)


def _parse(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The main chain: blocks with their sections, the sections, and reading units."""
    found, own = _sections(spark, d)
    own = cut(own)
    placed = cut(navigation.assign_sections(found, own))
    return placed, own, units.book_units(placed, own)


@query()
def book_units(spark: SparkSession, d: str) -> DataFrame:
    """Pages and spans to reading units: lines without running lines, blocks, sections, passages, sentences, units with anchors."""
    return _parse(spark, d)[2]


@query()
def sections(spark: SparkSession, d: str) -> DataFrame:
    return _sections(spark, d)[1]


@query()
def book_metadata(spark: SparkSession, d: str) -> DataFrame:
    pages, lines, found = _lines_and_blocks(spark, d)
    given = records(spark, d).select(F.col("id").alias("bookid"), "title", T.file_name(F.col("localpath")).alias("filename")).join(pages.select("bookid").distinct(), "bookid", "left_semi")
    return metadata.book_metadata(lines, found, given, table(spark, d, "text_span"))


@query(f"""WITH {ONE_RECORD}, t AS (SELECT id, array_to_string(list_concat([coalesce(doi, '')], isbns), ' | ') t FROM man1)
SELECT id, regexp_replace(unnest(regexp_extract_all(t, '(?i)(97[89][\\s-]?[\\dX][\\dX\\s-]{{8,20}}[\\dX])', 1)), '[\\s-]+', '', 'g') AS isbn FROM t""")
def record_isbns(spark: SparkSession, d: str) -> DataFrame:
    t = F.array_join(F.concat(F.array(F.coalesce("doi", F.lit(""))), "isbns"), " | ")
    found = records(spark, d).select("id", F.explode(F.regexp_extract_all(t, F.lit("(?i)(97[89][\\s-]?[\\dX][\\dX\\s-]{8,20}[\\dX])"), F.lit(1))).alias("x"))
    return found.select("id", F.regexp_replace("x", "[\\s-]+", "").alias("isbn"))


# --- EPUB -----------------------------------------------------------------------------------------------------------


def _packed_documents(spark: SparkSession, d: str) -> DataFrame:
    """Every document as an EPUB archive, a chapter per blank-line part."""
    docs = table(spark, d, "documents").where(F.col("text").isNotNull()).select("doc_id", F.regexp_replace("text", "[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\ufffe\\uffff]", "").alias("text"))

    def run(batches):
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            made = [epub.write_book(f"Document {i}", [(f"Chapter {k + 1}", [p]) for k, p in enumerate(t.split("\n\n"))]) for i, t in zip(ids, texts)]
            yield pa.RecordBatch.from_arrays([pa.array([f"{i}.epub" for i in ids]), pa.array(made, pa.binary())], names=["path", "content"])

    return scans.spread(docs, ["doc_id"]).mapInArrow(run, "path string, content binary")


@query("""WITH p AS (SELECT doc_id, trim(regexp_replace(regexp_replace(unnest(string_split(text, chr(10) || chr(10))), '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]', '', 'g'), '[\\t\\n\\x0b\\f\\r\\p{Z}]+', ' ', 'g')) t FROM documents WHERE text IS NOT NULL)
SELECT doc_id || '.epub' AS file, count(*) AS headings, count(*) FILTER (t <> '') AS paragraphs, CAST(coalesce(sum(length(t)), 0) AS BIGINT) AS characters FROM p GROUP BY 1""")
def epub_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Documents written as EPUB archives and read again: headings, paragraphs and their characters."""
    blocks = epub.book_blocks(epub.read_books(_packed_documents(spark, d)))
    prose = F.col("kind") == "prose"
    return blocks.groupBy("file").agg(F.sum((~prose).cast("long")).alias("headings"), F.sum(prose.cast("long")).alias("paragraphs"), F.coalesce(F.sum(F.when(prose, F.length("text"))), F.lit(0)).alias("characters"))


@query("SELECT 'epub' AS format, count(*) AS n FROM documents WHERE text IS NOT NULL")
def book_formats(spark: SparkSession, d: str) -> DataFrame:
    return _packed_documents(spark, d).groupBy(epub.book_format(F.col("content")).alias("format")).agg(F.count("*").alias("n"))


# --- smaller operators ----------------------------------------------------------------------------------------------


@query()
def repaired_units(spark: SparkSession, d: str) -> DataFrame:
    return repairs.repaired_units(progress.unit_rows(table(spark, d, "prediction")))


@query()
def supplements(spark: SparkSession, d: str) -> DataFrame:
    """Notes, captions, tables and references with the nearest unit of the same parse."""
    placed, _, own = _parse(spark, d)
    return repairs.supplements(placed, cut(own.select("bookid", "sectionno", "unitno", "pageindex", "sourcepages")))


@query(f"""WITH g AS (SELECT DISTINCT bookid, coalesce(trim(title), '') = '' a, readingstartpage IS NULL OR readingstartpage < 0 b, coalesce(bodywordcount < 0, false) c,
  len(list_filter(coalesce(sections, []), lambda s: s.kind IS NULL OR s.kind NOT IN ({', '.join(S.lit(k) for k in (*T.FRONT_KINDS, *T.BACK_KINDS, *T.BODY_KINDS, 'acknowledgments'))}))) > 0 d,
  len(list_filter(coalesce(sections, []), lambda s: s.startpage < 0 OR s.level < 0)) > 0 e, len(list_filter(coalesce(blocks, []), lambda b: coalesce(trim(b.text), '') = '')) > 0 f FROM annotation)
SELECT bookid, 'title' AS rule FROM g WHERE a UNION SELECT bookid, 'readingstartpage' FROM g WHERE b UNION SELECT bookid, 'bodywordcount' FROM g WHERE c UNION SELECT bookid, 'sectionkind' FROM g WHERE d UNION SELECT bookid, 'sectionplace' FROM g WHERE e UNION SELECT bookid, 'blocktext' FROM g WHERE f""")
def gold_violations(spark: SparkSession, d: str) -> DataFrame:
    return repairs.gold_violations(table(spark, d, "annotation"))


@query(f"""WITH {OFFSETS}, r AS (SELECT bookid, sectionno, min(unitno) a FROM us WHERE sectionno IS NOT NULL GROUP BY 1, 2), s AS (SELECT sections.bookid, sections.sectionno, sections.kind, coalesce(a, -1) a FROM sections LEFT JOIN r ON r.bookid = sections.bookid AND r.sectionno = sections.sectionno)
SELECT bookid, CAST(coalesce(arg_min(a, sectionno) FILTER (kind IN ({', '.join(S.lit(k) for k in T.BODY_KINDS)}) AND a >= 0 AND kind NOT IN ('foreword', 'preface')), arg_min(a, sectionno) FILTER (kind IN ({', '.join(S.lit(k) for k in T.BODY_KINDS)}) AND a >= 0), 0) AS INT) AS startunit FROM s GROUP BY 1""")
def reading_starts(spark: SparkSession, d: str) -> DataFrame:
    own = progress.section_rows(table(spark, d, "prediction"))
    placed = progress.units_in_sections(progress.unit_rows(table(spark, d, "prediction")), own)
    ranges = repairs.unit_ranges(own.withColumn("parentno", F.lit(None).cast("int")), placed.where(F.col("sectionno").isNotNull()).select("bookid", "unitno", "sectionno"))
    return repairs.reading_starts(ranges).select("bookid", F.col("startunit").cast("int").alias("startunit"))


@query()
def unsteady_progress(spark: SparkSession, d: str) -> DataFrame:
    found = repairs.unsteady_progress(progress.progress(_offsets(spark, d)))
    return found.select("bookid", "unitno", F.round("fraction", 6).alias("fraction"), F.round("before", 6).alias("before"))


@query()
def chapter_units(spark: SparkSession, d: str) -> DataFrame:
    """The reading unit where each chapter found in the source begins."""
    found = navigation.source_chapters(_evidence(spark, d)).where(F.col("confidence") >= navigation.ACCEPT).withColumn("endline", F.col("lineno") + 1)
    return progress.chapter_units(found, progress.unit_rows(table(spark, d, "prediction")), page_pages(spark, d))


@query(f"""WITH {UNITS}, {SECTIONS.split('), ', 1)[1]}, c AS (SELECT s.bookid, s.title, s.sectionno, (SELECT min(unitno) FROM units x WHERE x.bookid = s.bookid AND x.u.anchor.pageindex >= s.startpage) unitno FROM sections s),
m AS (SELECT bookid, unitno, max(title) title FROM c WHERE unitno IS NOT NULL GROUP BY 1, 2)
SELECT u.bookid, CAST(u.unitno AS INT) AS unitno, m.title FROM units u ASOF LEFT JOIN m ON u.bookid = m.bookid AND u.unitno >= m.unitno""")
def current_chapters(spark: SparkSession, d: str) -> DataFrame:
    """The section that each unit is read in, by the units where sections begin."""
    own = progress.unit_rows(table(spark, d, "prediction"))
    ahead = own.where(F.col("pageindex").isNotNull()).select("bookid", (-F.col("pageindex")).alias("minus"), F.struct((-F.col("unitno")).alias("u")).alias("_first"))
    sections_ = progress.section_rows(table(spark, d, "prediction"))
    starts = scans.backward_asof(sections_.select("bookid", (-F.col("startpage")).alias("minus"), "title", "sectionno"), ahead, ["bookid"], "minus", "_first")
    return progress.current_chapters(own, starts.select("bookid", (-F.col("_first.u")).alias("unitno"), "title").where(F.col("unitno").isNotNull()))
