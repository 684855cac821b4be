"""Sequential shapes on distributed tables: running sums, backward and nearest as-of joins, islands, streamed groups.

Running sums and as-of joins take two steps, within chunks of a group's order and across the chunks, so that a group
that holds a third of all rows is not the work of one task. ``map_groups`` is for logic that needs one bounded group
(a page) in order; it streams sorted partitions instead of building one frame per group.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

CHUNK = 4096


def chunk_of(order: Column, size: int = CHUNK) -> Column:
    return F.floor(order / F.lit(size)).cast("long")


def running_sum(df: DataFrame, group: list[str], order: str, value: str, out: str, chunk: int = CHUNK) -> DataFrame:
    """``df`` with ``out``, the sum of ``value`` over the rows of the group before this one. ``order`` is an integer without ties in its group."""
    chunked = df.withColumn("_chunk", chunk_of(F.col(order), chunk))
    totals = chunked.groupBy(*group, "_chunk").agg(F.sum(value).alias("_total"))
    ahead = totals.withColumn("_ahead", F.sum("_total").over(Window.partitionBy(*group).orderBy("_chunk")) - F.col("_total")).drop("_total")
    inside = F.sum(value).over(Window.partitionBy(*group, "_chunk").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)) - F.col(value)
    return chunked.withColumn("_inside", inside).join(ahead, [*group, "_chunk"]).withColumn(out, F.col("_inside") + F.col("_ahead")).drop("_chunk", "_inside", "_ahead")


def backward_asof(left: DataFrame, right: DataFrame, group: list[str], at: str, carry: str, chunk: int = CHUNK) -> DataFrame:
    """``left`` with ``carry`` (a struct column of ``right``) of the last row of ``right`` with the same group and ``at`` not above its own.

    Among rows of ``right`` at one place the largest struct counts. No inequality join: both sides are put in one order.
    """
    marks = right.groupBy(*group, at).agg(F.max(carry).alias("_mark")).withColumn("_side", F.lit(0))
    rest = [c for c in left.columns if c not in (*group, at)]
    packed = left.select(*group, at, F.struct(*rest).alias("_row") if rest else F.lit(None).alias("_row")).withColumn("_side", F.lit(1))
    both = packed.unionByName(marks, allowMissingColumns=True).withColumn("_chunk", chunk_of(F.col(at), chunk))
    last = marks.withColumn("_chunk", chunk_of(F.col(at), chunk)).groupBy(*group, "_chunk").agg(F.max_by("_mark", at).alias("_last"))
    spots = both.select(*group, "_chunk").distinct().join(last, [*group, "_chunk"], "left")
    before = F.last("_last", ignorenulls=True).over(Window.partitionBy(*group).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1))
    spots = spots.withColumn("_before", before).drop("_last")
    here = F.last("_mark", ignorenulls=True).over(Window.partitionBy(*group, "_chunk").orderBy(at, "_side").rowsBetween(Window.unboundedPreceding, 0))
    found = both.withColumn("_here", here).join(spots, [*group, "_chunk"]).where("_side = 1")
    return found.select(*group, at, *[F.col(f"_row.{c}").alias(c) for c in rest], F.coalesce("_here", "_before").alias(carry))


def nearest(left: DataFrame, right: DataFrame, group: list[str], at: str, tie: str, chunk: int = CHUNK) -> DataFrame:
    """``left`` with ``tie`` of the row of ``right`` nearest in ``at``; of two equally near ones, that with the smaller ``tie``. ``at`` is an integer."""
    first = right.groupBy(*group, at).agg(F.min(tie).alias("_tie"))
    back = first.select(*group, at, F.struct(F.col(at).alias("p"), F.col("_tie").alias("t")).alias("_back"))
    ahead = first.select(*group, (-F.col(at)).alias("_minus"), F.struct((-F.col(at)).alias("p"), F.col("_tie").alias("t")).alias("_ahead"))
    found = backward_asof(left, back, group, at, "_back", chunk)
    found = backward_asof(found.withColumn("_minus", -F.col(at)), ahead, group, "_minus", "_ahead", chunk).drop("_minus")
    apart = lambda c, sign: F.when(F.col(c).isNotNull(), F.struct(F.abs(F.col(at) - sign * F.col(f"{c}.p")).alias("d"), F.col(f"{c}.t").alias("t")))
    best = F.least(apart("_back", F.lit(1)), apart("_ahead", F.lit(-1)))
    return found.withColumn(tie, best["t"]).drop("_back", "_ahead")


def islands(df: DataFrame, group: list[str], order: list[str], joins: Column, out: str = "island") -> DataFrame:
    """``df`` with the number of the run that a row belongs to; ``joins`` says whether a row goes on with the one before (it may use ``lag`` columns made over the same order)."""
    w = Window.partitionBy(*group).orderBy(*order)
    starts = F.when(F.coalesce(joins, F.lit(False)), 0).otherwise(1)
    return df.withColumn(out, F.sum(starts).over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1)


def spread(df: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` by hash of the keys over as many partitions as shuffles have, for work that costs far more than its bytes tell: adaptive execution would merge small partitions to few tasks."""
    spark = df.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return df.repartition(parts, *keys)


def map_groups(df: DataFrame, keys: list[str], order: list[str], run: Callable[[dict[str, list]], dict[str, list]], schema: StructType | str) -> DataFrame:
    """``run`` over each group of ``keys`` in ``order``: columns as lists in, columns as lists out. A group must fit in memory."""
    if isinstance(schema, str):
        schema = StructType.fromDDL(schema)
    from pyspark.sql.pandas.types import to_arrow_schema

    target = to_arrow_schema(schema)
    names = df.columns

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {c: [] for c in names}
        out: dict[str, list] = {f.name: [] for f in target}

        def close() -> None:
            if held[names[0]]:
                for c, values in run(held).items():
                    out[c].extend(values)

        for batch in batches:
            columns = {c: batch.column(i).to_pylist() for i, c in enumerate(names)}
            ids = list(zip(*(columns[k] for k in keys)))
            start = 0
            for i in range(1, len(ids) + 1):
                if i == len(ids) or ids[i] != ids[i - 1]:
                    part = {c: columns[c][start:i] for c in names}
                    if held[names[0]] and tuple(held[k][-1] for k in keys) == ids[start]:
                        for c in names:
                            held[c].extend(part[c])
                    else:
                        close()
                        held = part
                    start = i
            if len(out[target.names[0]]) > 20_000:
                yield pa.RecordBatch.from_pydict(out, schema=target)
                out = {f.name: [] for f in target}
        close()
        if out[target.names[0]]:
            yield pa.RecordBatch.from_pydict(out, schema=target)

    return spread(df, keys).sortWithinPartitions(*keys, *order).mapInArrow(stream, schema)


def number_rows(df: DataFrame, order: list[Column], out: str) -> DataFrame:
    """``df`` with its place (from 1) in a global order: range partitions, their sizes, and a place within each."""
    from quirefold.session import cut

    parts = max(1, df.sparkSession.sparkContext.defaultParallelism)
    sorted_ = cut(df.repartitionByRange(parts, *order).sortWithinPartitions(*order)).withColumn("_part", F.spark_partition_id())
    sizes = sorted_.groupBy("_part").agg(F.count("*").alias("_size"))
    ahead = sizes.select("_part", (F.sum("_size").over(Window.orderBy("_part")) - F.col("_size")).alias("_ahead"))  # a row per partition
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return sorted_.withColumn("_place", place).join(F.broadcast(ahead), "_part").withColumn(out, F.col("_place") + F.col("_ahead")).drop("_part", "_place", "_ahead")
