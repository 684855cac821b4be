"""Session set-up, table access and lineage cuts shared by every operator."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

PACKAGE = Path(__file__).resolve().parent
_SHIPPED: set[str] = set()


def build_session(app: str = "quirefold", cpus: int | str = "*", shuffle_partitions: int = 8, driver_memory: str = "8g") -> SparkSession:
    """A local session with the settings the operators assume: UTC, adaptive execution with skew joins, Arrow."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "128k")
        .config("spark.driver.memory", driver_memory)
        .config("spark.ui.enabled", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )
    settle(spark)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def settle(spark: SparkSession) -> None:
    """Session settings that results depend on.

    Spark 4.1 lets a union keep its children's hash partitioning; with adaptive coalescing the children's partitions then need not
    correspond, and an aggregate above the union that trusts them gives a key twice. So unions give none.
    """
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")


def ship(spark: SparkSession) -> None:
    """Send the package to the executors once per application, so Arrow functions can be imported there."""
    settle(spark)
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    path = Path(tempfile.mkdtemp(prefix="quirefold-")) / "quirefold_code.zip"  # read by the driver's file server only
    with zipfile.ZipFile(path, "w") as archive:
        for source in sorted(PACKAGE.rglob("*.py")):
            archive.write(source, Path("quirefold") / source.relative_to(PACKAGE))
    context.addPyFile(str(path))
    _SHIPPED.add(context.applicationId)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for lineage cuts: the cluster's spark.checkpoint.dir, else, on one machine only, a fresh folder; a cluster without one is an error."""
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = "file://" + os.path.join(tempfile.gettempdir(), f"quirefold-checkpoints-{uuid.uuid4().hex[:12]}")
    context.setCheckpointDir(named)
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder; later plans read it and survive lost executors."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
