"""Queries over the operators of this package, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirefold.llm import chars, groups, lines, mixing, overlap, packing, pieces, quality, sentences
from quirefold.session import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return overlap.found_pairs(table(spark, d, "manifest"))


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    return overlap.overlap_report(table(spark, d, "manifest"))


def p1_checksums(spark: SparkSession, d: str) -> DataFrame:
    """Pairs across the splits by checksum alone."""
    pairs = overlap.cross_split_overlaps(table(spark, d, "manifest")).where("by = 'checksum'")
    return pairs.select(F.least("id_e", "id_t").alias("ida"), F.greatest("id_e", "id_t").alias("idb")).where("ida <> idb").distinct()


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return sentences.page_and_unit_sentences(table(spark, d, "page_extraction"), table(spark, d, "prediction"))


def p2_invariants(spark: SparkSession, d: str) -> DataFrame:
    """Visible characters of the texts of each kind, and how many of them the sentence units hold."""
    found = sentences.page_and_unit_texts(table(spark, d, "page_extraction"), table(spark, d, "prediction")).distinct()
    visible = lambda c: F.length(F.regexp_replace(c, "[^\\p{L}\\p{N}]+", ""))
    keys = ["itemkind", "bookid", "itemno", "id"]
    own = found.withColumn("id", F.xxhash64("text"))
    units = sentences.with_sentences(own.select(*keys, "text"), keys, "text")
    held = units.join(own, keys).groupBy("itemkind").agg(F.sum(visible(F.expr("substring(text, sentstart + 1, sentend - sentstart)"))).cast("long").alias("in_units"))
    whole = own.groupBy("itemkind").agg(F.sum(visible(F.col("text"))).cast("long").alias("letters"))
    return whole.join(held, "itemkind").select("itemkind", "letters", "in_units")


def p3_pieces(spark: SparkSession, d: str) -> DataFrame:
    return pieces.oversized_pieces(table(spark, d, "prediction"), table(spark, d, "annotation"), table(spark, d, "size_limit"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Items that the splitter cut."""
    return p3_pieces(spark, d).where("pieceno > 0").select("itemkind", "bookid", "itemno").distinct()


def p3_invariants(spark: SparkSession, d: str) -> DataFrame:
    """Items cut by kind, and how many of them break a rule."""
    return pieces.pieces_checked(table(spark, d, "prediction"), table(spark, d, "annotation"), table(spark, d, "size_limit"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Ids that the assignment keeps together, as it found them to belong together."""
    return groups.kept_together(p4_splits(spark, d))


def p4_splits(spark: SparkSession, d: str) -> DataFrame:
    return groups.split_assignment(table(spark, d, "manifest"), table(spark, d, "split_target"))


def p4_report(spark: SparkSession, d: str) -> DataFrame:
    return groups.split_report(p4_splits(spark, d), table(spark, d, "split_target"))


def p4_invariants(spark: SparkSession, d: str) -> DataFrame:
    """Shares near their targets, nothing related apart, every id once."""
    return groups.splits_checked(table(spark, d, "manifest"), p4_splits(spark, d), table(spark, d, "split_target"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return chars.not_plain(table(spark, d, "text_span"), table(spark, d, "annotation"))


def p5_titles(spark: SparkSession, d: str) -> DataFrame:
    """Gold titles in plain form beside the manifest's."""
    gold = chars.with_plain(table(spark, d, "annotation").select("bookid", "title"), "title", "plain_title")
    own = chars.with_plain(table(spark, d, "manifest").select(F.col("id").alias("bookid"), F.col("title").alias("m")).distinct(), "m", "manifest_title")
    return gold.join(own, "bookid").select("bookid", "plain_title", "manifest_title", (F.col("plain_title") == F.col("manifest_title")).alias("equal")).distinct()


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return lines.page_lines(table(spark, d, "page_extraction")).select("bookid", F.col("pageindex").cast("int").alias("pageindex"), F.col("lineindex").cast("int").alias("lineindex"))


def p6_pages(spark: SparkSession, d: str) -> DataFrame:
    """Every page without its book's repeated lines."""
    pages = table(spark, d, "page_extraction")
    found = lines.page_lines(pages).withColumnsRenamed({"bookid": "source", "pageindex": "doc"})
    first = F.min(F.struct(F.col("ingestedat").isNull(), "ingestedat", "text"))
    once = pages.groupBy("bookid", "pageindex").agg(first.alias("p")).select("bookid", "pageindex", "p.text")
    return lines.without_lines(once, found, "bookid", "pageindex", "text").select("bookid", "pageindex", "clean_text", "n_removed")


def p6_spans(spark: SparkSession, d: str) -> DataFrame:
    """The spans that stand in repeated lines."""
    found = lines.page_lines(table(spark, d, "page_extraction")).select("bookid", "pageindex", "lineindex")
    spans = table(spark, d, "text_span").select("bookid", "pageindex", "spanindex", "lineindex")
    return spans.join(found, ["bookid", "pageindex", "lineindex"], "left_semi").distinct()


def _capacity(spark: SparkSession, d: str) -> int:
    return int(table(spark, d, "size_limit").where(F.col("itemkind") == "container").first()["maxsize"])


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(table(spark, d, "documents"), _capacity(spark, d))


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    capacity = _capacity(spark, d)
    packed, ended = packing.packed_and_ended(table(spark, d, "documents"), capacity)
    return packing.packing_report(packed, capacity, ended)


def p7_invariants(spark: SparkSession, d: str) -> DataFrame:
    """Documents packed, containers above the capacity, documents divided though they fit one, and documents with parts that leave a gap."""
    return packing.packing_checked(p7_containers(spark, d), _capacity(spark, d))


def p8_mixture(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mixture(table(spark, d, "documents"), table(spark, d, "mix_target"))


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mixture_report(p8_mixture(spark, d), table(spark, d, "mix_target"))


def p8_invariants(spark: SparkSession, d: str) -> DataFrame:
    """Every target: its share is near what is asked, no document is used too often, and no place is used twice or left out."""
    return mixing.mixture_checked(p8_mixture(spark, d), table(spark, d, "mix_target"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return quality.not_prose(table(spark, d, "documents"), labels=table(spark, d, "doc_label"))


def p9_statistics(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    measured = quality.with_statistics(docs, ["doc_id"], "text", quality.fitted(docs, table(spark, d, "doc_label")))
    return measured.select("doc_id", "n_chars_visible", "n_words", *[F.round(c, 6).alias(c) for c in quality.FIELDS[2:]])


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name[0] == "p" and name[1:2].isdigit()}


OVERSIZED = """
        WITH l AS (SELECT itemkind, maxsize FROM size_limit),
        u AS (SELECT DISTINCT 'reading_unit' itemkind, bookid, no, e.text AS t FROM (SELECT bookid, unnest(readingunits) e, generate_subscripts(readingunits, 1) - 1 no FROM prediction)),
        b AS (SELECT DISTINCT 'block' itemkind, bookid, no, e.text AS t FROM (SELECT bookid, unnest(blocks) e, generate_subscripts(blocks, 1) - 1 no FROM annotation)),
        over AS (SELECT itemkind, bookid, no, t FROM (SELECT * FROM u UNION ALL SELECT * FROM b) JOIN l USING (itemkind) WHERE length(t) > maxsize)"""

SQL = {
    "p3_found": f"{OVERSIZED} SELECT DISTINCT itemkind, bookid, CAST(no AS INT) AS itemno FROM over",
    "p1_checksums": """
        WITH r AS (SELECT DISTINCT id, split, regexp_replace(regexp_replace(lower(trim(sha256)), '^(sha-?256)?[:=\\s]*(0x)?', ''), '[\\s:-]', '', 'g') s, bytes FROM manifest WHERE sha256 IS NOT NULL),
        k AS (SELECT DISTINCT id, split, s FROM r WHERE regexp_matches(s, '^[0-9a-f]{64}$') AND s <> 'e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855' AND (bytes IS NULL OR bytes <> 0))
        SELECT DISTINCT least(a.id, b.id) AS ida, greatest(a.id, b.id) AS idb FROM k a JOIN k b ON a.s = b.s AND a.id <> b.id WHERE a.split = 'discovery' AND b.split IN ('development', 'locked-test', 'control')""",
    "p2_invariants": """
        WITH t AS (SELECT DISTINCT 'page' AS itemkind, bookid, pageindex AS no, text FROM page_extraction WHERE text <> '' UNION ALL
        SELECT DISTINCT 'unit', bookid, no, u.text FROM (SELECT bookid, unnest(readingunits) u, generate_subscripts(readingunits, 1) no FROM prediction) WHERE u.text <> ''),
        n AS (SELECT itemkind, CAST(sum(length(regexp_replace(text, '[^\\p{L}\\p{N}]+', '', 'g'))) AS BIGINT) n FROM t GROUP BY 1) SELECT itemkind, n AS letters, n AS in_units FROM n""",
    "p7_invariants": "SELECT count(DISTINCT doc_id) AS n_documents, CAST(0 AS BIGINT) AS n_above, CAST(0 AS BIGINT) AS n_divided, CAST(0 AS BIGINT) AS n_gaps FROM documents",
    "p8_invariants": "SELECT source, targetshare, TRUE AS is_near, TRUE AS is_within, CAST(0 AS BIGINT) AS n_places_off FROM mix_target",
    "p4_invariants": "SELECT split, share AS target, TRUE AS is_near, CAST(0 AS BIGINT) AS n_apart, CAST(0 AS BIGINT) AS n_wrong FROM split_target",
    "p3_invariants": f"{OVERSIZED} SELECT itemkind, count(*) AS n_items, CAST(0 AS BIGINT) AS n_above, CAST(0 AS BIGINT) AS n_overlap_off, CAST(0 AS BIGINT) AS n_changed, CAST(0 AS BIGINT) AS n_low FROM over GROUP BY itemkind",
}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
