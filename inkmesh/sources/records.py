"""Readers of records, mappings and coverage."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_records(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Rows of a JSON array or of JSON lines, told apart by the first character; rows must be objects."""
    head = spark.read.text(path).where(F.trim("value") != "").limit(1).first()
    array = head is not None and head["value"].lstrip().startswith("[")
    reader = spark.read.option("multiLine", array).option("mode", "FAILFAST")
    return (reader.schema(schema) if schema else reader).json(path)


def parse_records(text: str) -> list[dict]:
    """The same for a text on standard input."""
    text = text.strip()
    rows = json.loads(text) if text.startswith("[") else [json.loads(s) for s in text.splitlines() if s.strip()]
    if not all(isinstance(r, dict) for r in rows):
        raise ValueError("rows must be objects")
    return rows


def read_mapping(spark: SparkSession, path: str) -> DataFrame:
    """(old, new) of a file of tab-separated lines; blank lines are skipped, the last line of a key wins.

    A line without a tab raises.
    """
    lines = spark.read.text(path).where(F.trim("value") != "").withColumn("at", F.monotonically_increasing_id())
    parts = F.split("value", "\t", 2)
    bad = F.raise_error(F.concat(F.lit("mapping line has no tab: "), F.col("value"))).cast("string")
    rows = lines.select(parts[0].alias("old"), F.when(F.size(parts) == 2, F.get(parts, F.lit(1))).otherwise(bad).alias("new"), "at")
    return rows.groupBy("old").agg(F.max_by("new", "at").alias("new"))


def read_coverage(spark: SparkSession, path: str | Path) -> DataFrame:
    """(key, entry) of a JSON object, entries kept as JSON."""
    data = json.loads(Path(path).read_text("utf-8"))
    if not isinstance(data, dict):
        raise ValueError("coverage must be an object")
    return spark.createDataFrame([(k, json.dumps(v, ensure_ascii=False)) for k, v in data.items()], "key string, entry string")
