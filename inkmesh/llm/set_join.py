"""All similar pairs between set-valued records (problem 5).

Recursive chosen-path splitting. A node is a path of tokens; its records hold all of them. A
record of size a goes down to the children of its tokens x for which hash(node, x) falls below
c / (tau * a - depth), so two records with Jaccard >= tau share c children on average. Small
nodes are brute-forced: a 256-bit parity sketch, whose differing bits never exceed the
differing elements, drops most pairs inside the join, and the rest are verified exactly. Trees
are repeated; with c = 3 a pair at the threshold is missed by one tree with probability of
about 0.06, by all TREES of them 0.06 ** TREES, and likelier pairs less.

Exact cases: equal sets are collapsed first; a record with few tokens takes every child; in a
large node at depth d the pairs with (size sum) <= d * (1 + tau) / tau are similar by the
path alone and are emitted as they are; what is still large at MAX_DEPTH is brute-forced in
blocks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkmesh.llm.common import expand, hamming, max_difference, parity_sketch
from inkmesh.operators.blocks import meet
from inkmesh.session import cut, skew_join

TREES, BRANCH, LEAF, MAX_DEPTH, WORDS = 4, 3.0, 256, 6, 4
_SK = [f"s{w}" for w in range(WORDS)]


def classes(sets: DataFrame, set_id: str = "set_id", values: str = "neighbors") -> tuple[DataFrame, DataFrame]:
    """(reps: rep, tokens), (members: rep, id). Nulls and repeats in a set are ignored."""
    tokens = F.array_sort(F.array_distinct(F.array_compact(F.col(values))))
    base = sets.select(F.col(set_id).alias("id"), tokens.alias("tokens")).where("id is not null and size(tokens) > 0")
    base = base.withColumn("fp", F.sha2(F.to_json("tokens"), 256))
    reps = base.groupBy("fp").agg(F.min("id").alias("rep"), F.first("tokens").alias("tokens"), F.count(F.lit(1)).alias("n"))
    members = skew_join(base.select("fp", "id"), reps.select("fp", "rep", "n"), "fp", "n", "id")
    return reps.select("rep", "tokens"), members.select("rep", "id")


def _children(rows: DataFrame, depth: int, tau: float, branch: float) -> DataFrame:
    """Children of (node, used) for records (rep, size, h, ...)."""
    room = F.col("size") * F.lit(tau) - depth
    p = F.when(room <= branch, F.lit(1.0)).otherwise(F.lit(branch) / room)
    limit = (p * F.lit(float(1 << 32))).cast("bigint")
    # Hashes are all that is made for every token; nodes and paths only for the chosen ones.
    low = lambda x: F.pmod(F.shiftrightunsigned(F.xxhash64("node", x), 20), F.lit(1 << 32)) < limit
    chosen = F.filter("h", low if not depth else lambda x: low(x) & ~F.array_contains("used", x))
    kept = [c for c in rows.columns if c not in ("h", "node", "used")]
    each = rows.select(*kept, "node", *(["used"] if depth else []), F.explode(chosen).alias("x"))
    used = F.array_append("used", F.col("x")) if depth else F.array("x")
    return each.select(*kept, F.xxhash64("node", "x").alias("node"), used.alias("used"))


def candidates(reps: DataFrame, tau: float, trees: int, branch: float, leaf: int) -> DataFrame:
    """Distinct candidate pairs (a, b) of set classes that pass the sketch."""
    h = F.transform("tokens", lambda x: F.xxhash64(x))
    facts = cut(reps.select("rep", F.size("tokens").alias("size"), h.alias("h")).select("*", *parity_sketch(F.col("h"), WORDS)))
    ratio = (F.least("a_size", "b_size") >= F.greatest("a_size", "b_size") * F.lit(tau) - 1e-9) & (
        hamming(WORDS) <= max_difference(F.col("a_size"), F.col("b_size"), tau)
    )
    found: DataFrame | None = None

    def take(rows: DataFrame, where) -> None:
        nonlocal found
        p = meet(rows, "node", "n", "rep", ["size", *_SK], where)
        p = p.select(F.col("a_rep").alias("a"), F.col("b_rep").alias("b"))
        found = p if found is None else found.unionByName(p)

    start = facts.withColumn("node", F.explode(F.array(*(F.xxhash64(F.lit(t)) for t in range(trees)))))
    rows = _children(start, 0, tau, branch)
    for depth in range(1, MAX_DEPTH + 1):
        sizes = rows.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        live = skew_join(rows, sizes.withColumn("k", F.col("n")), "node", "k", "rep")
        live = cut(live)
        if depth == MAX_DEPTH:
            take(live, ratio)
            break
        take(live.where(F.col("n") <= leaf), ratio)
        large = live.where(F.col("n") > leaf)
        # Similar by the path alone: small sets, counted anew so that blocks fit them.
        sure = large.where(F.col("size") <= F.lit(depth * (1 + tau) / tau) - depth + 1e-9).drop("n")
        count = sure.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        by_path = (F.col("a_size") + F.col("b_size")) <= F.lit(depth * (1 + tau) / tau + 1e-9)
        take(skew_join(sure, count.withColumn("k", F.col("n")), "node", "k", "rep"), by_path)
        if large.isEmpty():
            break
        rows = _children(large.drop("n").join(facts.select("rep", "h"), "rep"), depth, tau, branch)
    return found.distinct()


def similar_classes(reps: DataFrame, tau: float = 0.5, trees: int = TREES, branch: float = BRANCH, leaf: int = LEAF) -> DataFrame:
    """(a, b, score) of set classes with Jaccard >= tau, verified on the strings."""
    pairs = candidates(reps, tau, trees, branch, leaf)
    a = reps.select(F.col("rep").alias("a"), F.col("tokens").alias("ta"))
    b = reps.select(F.col("rep").alias("b"), F.col("tokens").alias("tb"))
    common = F.size(F.array_intersect("ta", "tb"))
    both = pairs.join(a, "a").join(b, "b").withColumn("i", common)
    score = F.col("i") / (F.size("ta") + F.size("tb") - F.col("i"))
    return both.select("a", "b", score.alias("score")).where(F.col("score") >= tau)


def similar_pairs(sets: DataFrame, tau: float = 0.5, **kw) -> DataFrame:
    """(set_a, set_b) with set_a < set_b of all records whose sets reach ``tau``.

    Null and empty sets and null ids are never a case, nulls and repeats in a set are ignored,
    a record delivered twice counts once, an empty table gives no rows, extra columns are
    ignored. Equal sets are pairs of score 1.
    """
    reps, members = classes(sets)
    reps = cut(reps)
    pairs = similar_classes(reps, tau, **kw).select("a", "b")
    out = expand(pairs, members)
    return out.select(F.col("a").alias("set_a"), F.col("b").alias("set_b"))


def links_per_record(sets: DataFrame, tau: float = 0.5, **kw) -> DataFrame:
    """Per record its class, the size of the class and its number of linked classes and best score."""
    reps, members = classes(sets)
    reps = cut(reps)
    pairs = similar_classes(reps, tau, **kw)
    ends = pairs.select(F.col("a").alias("rep"), "score").unionByName(pairs.select(F.col("b").alias("rep"), "score"))
    facts = ends.groupBy("rep").agg(F.count(F.lit(1)).alias("linked"), F.max("score").alias("best"))
    own = members.distinct().groupBy("rep").agg(F.count(F.lit(1)).alias("copies"))
    return (
        members.distinct()
        .join(own.join(facts, "rep", "left"), "rep")
        .select(
            F.col("id").alias("set_id"),
            F.col("rep").alias("class_id"),
            "copies",
            F.coalesce("linked", F.lit(0)).alias("linked_classes"),
            F.when(F.col("copies") > 1, F.lit(1.0)).otherwise(F.col("best")).alias("best_score"),
        )
    )
