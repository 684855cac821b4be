"""Joins with a table of one row per key in which one key may have a third of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT_ROWS, HOT_KEYS = 100_000, 1000  # a key is hot above so many rows and this part of all rows, so at most HOT_KEYS of them are
SPREAD = 64  # tasks that share a hot key


def joined(rows: DataFrame, per_key: DataFrame, keys: list[str], by: str, total: int, n: str = "n") -> DataFrame:
    """``rows`` (``total`` of them, or less) joined with ``per_key``, whose ``n`` is the number of rows of the key.

    Rows of hot keys are spread by ``by`` and the key's row is repeated for each of the SPREAD tasks; the list of hot keys
    that is broadcast has at most HOT_KEYS rows, whatever the data.
    """
    most = max(HOT_ROWS, total // HOT_KEYS)
    if total <= most:
        return rows.join(per_key, keys)
    hot = per_key.where(F.col(n) > most).select(*keys, F.lit(True).alias("_hot"))
    spread = rows.join(F.broadcast(hot), keys, "left").withColumn("_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64(by), F.lit(SPREAD)).cast("int")).otherwise(0)).drop("_hot")
    salts = F.when(F.col(n) > most, F.sequence(F.lit(0), F.lit(SPREAD - 1))).otherwise(F.array(F.lit(0)))
    return spread.join(per_key.withColumn("_salt", F.explode(salts)), [*keys, "_salt"]).drop("_salt")
