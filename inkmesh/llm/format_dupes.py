"""Duplicates hidden by formatting differences (problem 2).

Progressive partition refinement. Records are first grouped by cheap invariants of their
normal form, then only classes with several members by costlier ones:

1. stripped length of the digest, number of paths, count;
2. the letter histogram of digest and paths together;
3. the full normal form.

The texts of what stays after the first step are cleaned once, for both costlier keys; the stages
after it move only ids and hashes. A class whose smallest and largest id agree
has one member and leaves at once; both come from partial aggregates, so a class with a third of
all rows costs no more than any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkmesh.functions.text import letters_digits
from inkmesh.session import cut, skew_join


def _several(rows: DataFrame, key: str) -> DataFrame:
    """Rows whose class has at least two different ids; ``key`` becomes their class."""
    classes = rows.groupBy(key).agg(
        F.min("row_id").alias("_lo"), F.max("row_id").alias("_hi"), F.count(F.lit(1)).alias("_n")
    )
    classes = classes.where("_lo < _hi").select(key, "_n")
    return skew_join(rows, classes, key, "_n", "row_id", "left_semi")


def _histogram(texts: Column) -> Column:
    """Hash of the multiset of characters."""
    return F.xxhash64(F.array_join(F.array_sort(F.split(F.array_join(texts, "", ""), "")), ""))


def copies(rows: DataFrame) -> DataFrame:
    """(row_id, first_id, copies) of every record that has copies.

    Records are copies when digest and paths (as multisets) agree in letters and digits without
    case and ``count`` agrees, null equal to null. Null digest or paths: never a copy; a null
    element of paths equals only another null; an empty array is a value like any other. A row
    delivered twice is one record. Columns other than row_id, sha256, paths, count are ignored.
    """
    base = rows.select("row_id", "sha256", "paths", "count").where(
        "row_id is not null and sha256 is not null and paths is not null"
    )
    one = base.withColumn("k1", F.xxhash64(F.length(letters_digits(F.col("sha256"))), F.size("paths"), "count"))
    # Only members of classes of several are cleaned, once each: one step for each column that the next uses twice.
    clean = _several(one, "k1").select(
        "row_id", "k1", letters_digits(F.col("sha256")).alias("d"), F.array_sort(F.transform("paths", letters_digits)).alias("p"), F.col("count").alias("c")
    )
    form = F.sha2(F.to_json(F.struct("d", "p", "c"), {"ignoreNullFields": "false"}), 256)
    hashed = cut(clean.select("row_id", F.xxhash64("k1", _histogram(F.concat(F.array("d"), "p"))).alias("k2"), form.alias("k3")))
    three = _several(hashed, "k2").select("row_id", "k3")
    classes = (
        three.distinct().groupBy("k3").agg(F.min("row_id").alias("first_id"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    )
    return skew_join(three, classes.withColumn("copies", F.col("_n")), "k3", "_n", "row_id").select("row_id", "first_id", "copies").distinct()


def copy_pairs(rows: DataFrame) -> DataFrame:
    """(first_id, row_id) of every copy but the first of its class."""
    return copies(rows).where("row_id <> first_id").select("first_id", "row_id")


def collapse(rows: DataFrame) -> DataFrame:
    """One record per class with its number of copies; all others with 1.

    Rows with null digest or paths stay, each for itself. A null row_id is dropped.
    """
    known = copies(rows)
    once = rows.select("row_id", "sha256", "paths", "count").where("row_id is not null").dropDuplicates(["row_id"])
    kept = once.join(known, "row_id", "left").where("first_id is null or first_id = row_id")
    return kept.select(
        "row_id", "sha256", F.size("paths").alias("n_paths"), "count", F.coalesce("copies", F.lit(1)).cast("bigint").alias("copies")
    )
