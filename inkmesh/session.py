"""Session creation and the few helpers that touch cluster settings."""

from __future__ import annotations

import os
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Keys salted by skew_join; any other key holds at most 1/HOT_KEYS of the rows.
HOT_KEYS = 256


def get_spark(app: str = "inkmesh", cpus: int | str | None = None) -> SparkSession:
    """A session for local work; on a cluster the caller brings its own."""
    cpus = cpus or os.environ.get("BENCH_CPUS", "8")
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("INKMESH_DRIVER_MEMORY", "8g"))
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder the session names; a local one only where none is set."""
    if spark.sparkContext.getCheckpointDir():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and (spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="inkmesh-ckpt-"))


def cut(df: DataFrame, eager: bool = True) -> DataFrame:
    """Cut lineage with a reliable checkpoint, so that loops survive lost executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager)


def cut_round(df: DataFrame) -> DataFrame:
    """``cut`` for a loop's state: the estimated size is forgotten too.

    A checkpoint keeps its plan's estimate, and joins multiply estimates, so that the number
    itself would grow exponentially with the rounds.
    """
    spark, kept = df.sparkSession, cut(df)
    try:
        plan = kept._jdf
        return DataFrame(spark._jsparkSession.internalCreateDataFrame(plan.queryExecution().toRdd(), plan.schema(), False), spark)
    except (AttributeError, TypeError):  # no such call in this Spark: the estimate stays, the rows are the same
        return kept


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def skew_join(
    rows: DataFrame, keyed: DataFrame, key: str, n: str, spread: str, how: str = "inner", salts: int = 64, hot_from: int = 20_000
) -> DataFrame:
    """Join many ``rows`` to ``keyed`` (one row per ``key``, ``n`` = its number of rows).

    The HOT_KEYS most frequent keys above ``hot_from`` rows are salted by ``spread``: that
    broadcast has at most HOT_KEYS rows whatever the data, and no unsalted key can hold more
    than 1/HOT_KEYS of all rows. The count in ``keyed`` must come from a partial aggregation.
    """
    hot = F.broadcast(
        keyed.where(F.col(n) > hot_from).orderBy(F.col(n).desc(), F.col(key)).limit(HOT_KEYS).select(F.col(key).alias("_hk"))
    )
    salt = F.pmod(F.xxhash64(F.col(spread)), F.lit(salts)).cast("int")
    left = rows.join(hot, rows[key] == F.col("_hk"), "left")
    left = left.withColumn("_salt", F.when(F.col("_hk").isNotNull(), salt).otherwise(F.lit(0))).drop("_hk")
    right = keyed.join(hot, keyed[key] == F.col("_hk"), "left")
    each = F.when(F.col("_hk").isNotNull(), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    right = right.withColumn("_salt", F.explode(each)).drop("_hk", n)
    # A row per key and salt: no partition of that side can be hot, so hashing it needs no sort of the many rows.
    return left.join(right.hint("shuffle_hash"), [key, "_salt"], how).drop("_salt")


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package whatever their working directory.

    The folder it lies in is put on their path: enough on one machine and where the package is
    installed or shared. Other clusters get it with spark-submit's --py-files.
    """
    env, root = spark.sparkContext.environment, str(Path(__file__).resolve().parents[1])
    known = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in known:
        env["PYTHONPATH"] = os.pathsep.join([root, *known])
