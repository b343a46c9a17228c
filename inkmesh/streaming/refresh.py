"""Streams of note versions: the latest version per path kept, batch operators run on each batch.

The reference behaviour is batch only; this is an extension.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

SCHEMA = "note_id bigint, path string, content string, sha256 string, origin string, created_at timestamp_ntz, deleted_at timestamp_ntz, loaded_at timestamp_ntz"


def link_events(notes: DataFrame, watermark: str = "7 days", window: str = "1 day") -> DataFrame:
    """Windowed counts of notes and their wikilinks by load time, late rows dropped at the watermark."""
    t = F.col("loaded_at").cast("timestamp")
    n = F.size(F.regexp_extract_all(F.coalesce("content", F.lit("")), F.lit(r"\[\[([^\]\n]+)\]\]"), F.lit(1)))
    rows = notes.withColumn("t", t).withWatermark("t", watermark).withColumn("links", n)
    return rows.groupBy(F.window("t", window).alias("w")).agg(F.count(F.lit(1)).alias("notes"), F.sum("links").alias("links")).select(
        F.col("w.start").alias("start"), F.col("w.end").alias("end"), "notes", "links"
    )


def run_on_batches(versions: DataFrame, operator: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Run a batch operator on each micro-batch; batch n overwrites out/batch=n, so a retried batch counts once."""

    def one(df: DataFrame, n: int) -> None:
        latest = df.groupBy("path").agg(F.max_by(F.struct(*df.columns), F.struct("loaded_at", "note_id")).alias("r")).select("r.*")
        operator(latest.select("path", F.col("content").alias("text"))).write.mode("overwrite").parquet(f"{out}/batch={n}")

    return versions.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
