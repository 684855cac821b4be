"""Counts, checks and look-ups over catalogue and parse tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def selected(records: DataFrame, ids: DataFrame | None = None, split: str | None = None, key: str = "id") -> DataFrame:
    """``records`` of a split and with an id of ``ids`` (a column of the same name); what is null selects all."""
    own = records if split is None else records.where(F.col("split") == split)
    return own if ids is None else own.join(ids.select(key).distinct(), key, "left_semi")


def counts_by_book(tables: dict[str, tuple[DataFrame, list[str]]], key: str = "bookid") -> DataFrame:
    """key and a column ``n_<name>`` for every table: its distinct rows by the columns named; 0 where a book has none there."""
    parts = [df.select(key, *columns).distinct().groupBy(key).agg(F.count("*").alias("n")).withColumn("name", F.lit(name)) for name, (df, columns) in tables.items()]
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    return every.groupBy(key).agg(*[F.coalesce(F.sum(F.when(F.col("name") == name, F.col("n"))), F.lit(0)).alias(f"n_{name}") for name in tables])


def mean_confidence(rows: DataFrame, by: list[str], confidence: str) -> DataFrame:
    """by, n, confidence: the mean over the rows that have one; null where none has."""
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.round(F.avg(confidence), 6).alias("confidence"))


def stratification(records: DataFrame, publishers: int, subjects: int, tiers: int, outlines: float) -> DataFrame:
    """One row: distinct publishers, subjects and length tiers, the share with an outline, and whether each reaches what is asked."""
    own = records.select("id", "publisher", "subjects", "pagetier", "hasoutline")
    spread = own.select(F.explode_outer("subjects").alias("s")).agg(F.count_distinct("s").alias("n_subjects"))
    one = own.agg(
        F.count_distinct(F.when(F.trim("publisher") != "", F.col("publisher"))).alias("n_publishers"), F.count_distinct("pagetier").alias("n_tiers"),
        F.round(F.avg(F.coalesce("hasoutline", F.lit(False)).cast("int")), 6).alias("outline_share"),
    )
    both = one.crossJoin(spread)  # one row each
    asked = {"n_publishers": publishers, "n_subjects": subjects, "n_tiers": tiers, "outline_share": outlines}
    met = [F.coalesce(F.col(c) >= least, F.lit(False)) for c, least in asked.items()]
    return both.select(*asked, F.array_join(F.filter(F.array(*[F.when(~ok, F.lit(c)) for ok, c in zip(met, asked)]), lambda x: x.isNotNull()), ",").alias("missed"))


def audit_totals(audit: DataFrame) -> DataFrame:
    """The corpus's row of a per-book audit."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return audit.agg(F.count("*").alias("books"), *[total(c) for c in ("pages", "sourcewords", "readingwords", "units", "oversized")], F.coalesce(F.max("maxwords"), F.lit(0)).alias("maxwords"))


def multimap(entries: Column) -> Column:
    """Key and value pairs as a map from each key in small letters to its distinct values in their order; blank values are left out."""
    own = F.filter(F.transform(entries, lambda e: F.struct(F.lower(F.trim(e["key"])).alias("key"), F.trim(e["value"]).alias("value"))), lambda e: (F.coalesce(e["value"], F.lit("")) != "") & e["key"].isNotNull())
    keys = F.array_distinct(F.transform(own, lambda e: e["key"]))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.array_distinct(F.transform(F.filter(own, lambda e: e["key"] == k), lambda e: e["value"]))))


def values_of(multi: Column, name: str) -> Column:
    """All distinct values of a key and of the keys below it (``a`` finds ``a`` and ``a.b``), keys in the map's order."""
    found = F.map_filter(multi, lambda k, _: (k == name) | F.startswith(k, F.lit(name + ".")))
    return F.array_distinct(F.flatten(F.map_values(found)))


def first_of(multi: Column, *names: str) -> Column:
    """The first value of the first of the names that has one."""
    return F.coalesce(*[F.try_element_at(values_of(multi, n), F.lit(1)) for n in names])
