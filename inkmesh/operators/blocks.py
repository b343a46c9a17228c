"""Pairs within groups of any size: a group is split into blocks, and pairs of blocks meet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of one group that meet in one task, at most twice this many.
BLOCK = 512


def blocked(rows: DataFrame, group: str, n: str, spread: str) -> DataFrame:
    """Give each row the block pairs (_g) of its group in which it meets the others.

    A group of n rows has ceil(n / BLOCK) blocks; two rows of one group share at least one _g.
    Rows keep ``_blk`` and ``_dia``, whether _g pairs their block with itself: rows of one block
    share all of its _g, so callers join on _g and let them meet in the diagonal only (see ``meet``).
    """
    blocks = F.ceil(F.col(n) / BLOCK).cast("int")
    own = F.pmod(F.xxhash64(F.col(spread), F.lit(7)), blocks).cast("int")
    other = F.sequence(F.lit(0), blocks - 1)
    return (
        rows.withColumn("_blk", own)
        .withColumn("_o", F.explode(other))
        .withColumn("_g", F.xxhash64(F.col(group), F.least("_blk", "_o"), F.greatest("_blk", "_o")))
        .withColumn("_dia", F.col("_blk") == F.col("_o"))
        .drop("_o")
    )


def meet(rows: DataFrame, group: str, n: str, spread: str, keep: list[str], where: Column | None = None) -> DataFrame:
    """Pairs (a_*, b_*) of rows of one group with a_<spread> < b_<spread>, each group pair once.

    ``where`` is a condition on the a_/b_ columns, applied inside the join.
    """
    b = blocked(rows, group, n, spread)
    cols = [*dict.fromkeys([spread, group, "_blk", "_dia", "_g", *keep])]
    left = b.select(*(F.col(c).alias(f"a_{c}") for c in cols))
    right = b.select(*(F.col(c).alias(f"b_{c}") for c in cols))
    on = (
        (F.col("a__g") == F.col("b__g"))
        & (F.col(f"a_{group}") == F.col(f"b_{group}"))
        & (F.col(f"a_{spread}") < F.col(f"b_{spread}"))
        & ((F.col("a__blk") != F.col("b__blk")) | F.col("a__dia"))
    )
    if where is not None:
        on = on & where
    return left.join(right, on)
