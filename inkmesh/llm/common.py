"""Pieces shared by the pair operators: expansion of classes, sketches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkmesh.operators.blocks import BLOCK, meet
from inkmesh.session import cut


def within(members: DataFrame) -> DataFrame:
    """(a, b) with a < b of all ids of one class; members: distinct (rep, id)."""
    n = members.groupBy("rep").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return meet(members.join(n, "rep"), "rep", "n", "id", []).select(F.col("a_id").alias("a"), F.col("b_id").alias("b"))


def across(links: DataFrame, members: DataFrame) -> DataFrame:
    """(x, y): a member of class a with a member of class b, for links (a, b) and distinct members (rep, id).

    Classes above BLOCK members are joined block by block, so no key of a join has more.
    """
    large = cut(members.groupBy("rep").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("k")).where("k > 1"))
    each, dealt = links.select("a", "b"), members.select("rep", "id")
    if large.isEmpty():  # the same rows by a shorter plan
        each = each.join(dealt.select(F.col("rep").alias("a"), F.col("id").alias("x")), "a")
        return each.join(dealt.select(F.col("rep").alias("b"), F.col("id").alias("y")), "b").select("x", "y")
    dealt = dealt.join(large, "rep", "left").withColumn("k", F.coalesce("k", F.lit(1)))
    dealt = dealt.select("rep", "id", F.pmod(F.xxhash64("id", F.lit(11)), F.col("k")).cast("int").alias("blk"))
    parts = lambda c: F.explode(F.sequence(F.lit(0), F.coalesce(F.col(c), F.lit(1)) - 1))
    for end in ("a", "b"):
        each = each.join(large.select(F.col("rep").alias(end), F.col("k").alias(f"k{end}")), end, "left")
    each = each.withColumn("ia", parts("ka")).withColumn("ib", parts("kb")).select("a", "b", "ia", "ib")
    for end, out in (("a", "x"), ("b", "y")):
        each = each.join(dealt.select(F.col("rep").alias(end), F.col("blk").alias(f"i{end}"), F.col("id").alias(out)), [end, f"i{end}"])
    return each.select("x", "y")


def expand(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """(a, b) with a < b of all ids whose classes are equal or linked.

    pairs: (a, b) of class ids; members: (rep, id). Only for results whose columns are ids of
    single records; the work is that of the result.
    """
    m = cut(members.distinct())
    other = across(pairs, m).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    return within(m).unionByName(other)


def parity_sketch(hashes: Column, words: int) -> list[Column]:
    """``words`` longs; every hash flips one bit. Differing bits never exceed differing elements."""
    at = F.shiftrightunsigned

    def word(w: int) -> Column:
        bit = lambda h: F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(at(h, 8), F.lit(64)).cast("int"))
        return F.aggregate(
            hashes,
            F.lit(0).cast("bigint"),
            lambda acc, h: F.when(F.pmod(at(h, 40), F.lit(words)) == w, acc.bitwiseXOR(bit(h))).otherwise(acc),
        )

    return [word(w).alias(f"s{w}") for w in range(words)]


def hamming(words: int, a: str = "a_", b: str = "b_") -> Column:
    total = F.lit(0)
    for w in range(words):
        total = total + F.bit_count(F.col(f"{a}s{w}").bitwiseXOR(F.col(f"{b}s{w}")))
    return total


def max_difference(size_a: Column, size_b: Column, tau: float) -> Column:
    """Largest symmetric difference of two sets of these sizes with Jaccard >= tau."""
    return F.floor((size_a + size_b) * F.lit((1 - tau) / (1 + tau)) + F.lit(1e-9))
