"""Lines repeated across one source's documents (problem 6).

Each line is normalised and hashed; a two-step count (distinct source, hash, document, then documents by source
and hash) gives the documents that have it; hashes above the threshold are joined back, and documents are rebuilt
without them. A hot line never meets one task: the first step is spread by document, and so is the join back of hot lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirefold.llm import hot
from quirefold.llm.chars import with_plain
from quirefold.session import cut


def numbered_lines(docs: DataFrame, source: str, doc: str, text: str, label: str | None = None) -> DataFrame:
    """One row per line: source, doc, lineindex, line, label (in small letters). Null texts have no lines."""
    own = F.trim(F.lower(F.upper(F.col(label)))) if label else F.lit(None).cast("string")
    docs = docs.withColumn("_label", own)  # once a document, not once a line
    return docs.where(F.col(text).isNotNull()).select(
        F.col(source).alias("source"), F.col(doc).alias("doc"), F.col("_label").alias("label"), F.posexplode(F.split(F.col(text), "\n")).alias("lineindex", "line")
    )


def line_keys(lines: DataFrame) -> DataFrame:
    """``lines`` with ``key``, the hash of what a line looks like apart from case, spacing and its own label; blank lines are left out.

    A line that is nothing but the label has a key too, so bare page numbers are equal to each other.
    """
    plain = with_plain(lines, "line", "plain", context=True).where(F.trim("plain") != "")
    # Columns that are read twice are steps of their own, so that they are computed once.
    plain = plain.withColumns({"plain": F.translate(F.lower(F.upper(F.col("plain"))), "ς", "σ"), "label": F.coalesce("label", F.lit(""))})
    own, folded = F.col("label"), F.col("plain")
    # Spacing is dropped anyway, so a label that is one word is left out of the line's words and signs; only other labels need a pattern of their own.
    signs = F.regexp_extract_all(folded, F.lit("[\\p{L}\\p{N}]+|[^\\p{L}\\p{N}]"), F.lit(0))
    words = F.array_join(F.filter(signs, lambda w: w != own), "")
    pattern = F.concat(F.lit("(?<![\\p{L}\\p{N}])\\Q"), F.regexp_replace(own, "\\\\E", ""), F.lit("\\E(?![\\p{L}\\p{N}])"))
    other = F.regexp_replace(folded, pattern, "")
    bare = F.when((own != "") & F.contains(folded, own), F.when(own.rlike("^[\\p{L}\\p{N}]+$"), words).otherwise(other)).otherwise(folded)
    return plain.withColumn("key", F.xxhash64(F.translate(bare, " \t\n\r\x0b\x0c", ""), F.lit("line"))).drop("plain")


def repeated_keys(keyed: DataFrame, docs: DataFrame | None = None, least_docs: int = 5, least_share: float = 0.0) -> DataFrame:
    """source, key, n_docs of lines that stand in at least ``least_docs`` documents and ``least_share`` of its source's documents."""
    counts = keyed.select("source", "key", "doc").distinct().groupBy("source", "key").agg(F.count("*").alias("n_docs")).where(F.col("n_docs") >= least_docs)
    if least_share > 0 and docs is not None:
        totals = docs.select("source", "doc").distinct().groupBy("source").agg(F.count("*").alias("n_source"))
        counts = counts.join(totals, "source").where(F.col("n_docs") >= F.lit(least_share) * F.col("n_source")).drop("n_source")
    return counts


def repeated_lines(docs: DataFrame, source: str, doc: str, text: str, label: str | None = None, least_docs: int = 5, least_share: float = 0.0) -> DataFrame:
    """source, doc, lineindex, n_docs of every non-blank line that recurs in its source.

    Documents delivered twice count once; a null source is no source and its lines are never repeated; empty tables give no rows.
    """
    own = docs.select(F.col(source).alias("source"), F.col(doc).alias("doc"), F.col(text).alias("text"), (F.col(label) if label else F.lit(None).cast("string")).alias("label"))
    own = own.where(F.col("source").isNotNull())
    keyed = cut(line_keys(numbered_lines(own, "source", "doc", "text", "label")).select("source", "doc", "lineindex", "key"))  # read twice
    found = repeated_keys(keyed, own, least_docs, least_share)
    return hot.joined(keyed, found, ["source", "key"], "doc", keyed.count(), "n_docs").select("source", "doc", "lineindex", "n_docs").distinct()


def without_lines(docs: DataFrame, found: DataFrame, source: str, doc: str, text: str) -> DataFrame:
    """``docs`` with ``clean_text``, the text without the found lines (null where the text is null), and ``n_removed``."""
    per = found.groupBy("source", "doc").agg(F.collect_set("lineindex").alias("_gone"))
    joined = docs.join(per.withColumnsRenamed({"source": "_s", "doc": "_d"}), (F.col(source) == F.col("_s")) & (F.col(doc) == F.col("_d")), "left").drop("_s", "_d")
    lines = F.split(F.col(text), "\n")
    kept = F.filter(lines, lambda _, i: ~F.array_contains(F.col("_gone"), i))
    clean = F.when(F.col("_gone").isNull(), F.col(text)).otherwise(F.array_join(kept, "\n"))
    return joined.withColumns({"clean_text": clean, "n_removed": F.coalesce(F.size("_gone"), F.lit(0))}).drop("_gone")


def page_lines(pages: DataFrame, least_docs: int = 5) -> DataFrame:
    """bookid, pageindex, lineindex, n_pages of the lines of pages that recur in their book; a null label stands for pageindex + 1."""
    labelled = pages.select("bookid", "pageindex", "text", F.coalesce(F.col("label"), (F.col("pageindex") + 1).cast("string")).alias("label"))
    return repeated_lines(labelled, "bookid", "pageindex", "text", "label", least_docs).withColumnsRenamed({"source": "bookid", "doc": "pageindex", "n_docs": "n_pages"})
