"""Near-duplicate records with small edits (problem 4): parity-sketch join.

A record is the set of its word shingles. Sets are banded by size, each band's tokens are
dealt to B blocks by hash, and a block's sketch is the XOR of its tokens' hashes. Sets with
Jaccard >= tau differ in at most D = (a + b)(1 - tau) / (1 + tau) tokens, so at least B - D
blocks agree (pigeonhole), B - D - E of those that hold tokens, where E are empty. Blocks that
no other set has agree with none; of the others, in order of rising frequency, a set needs as
keys only the first ones, so many that B - D - E agreements cannot all lie behind them. Sets that
meet in a key are compared by parity sketches, whose Hamming distance bounds the symmetric
difference from below, and what is left is verified on the tokens.

Nothing is lost to skew: blocks shared by more than HOT sets (H) are no keys, and a pair must
agree in B - D - E - H others. Only a set for which that is none also goes, with its tokens
ordered by rising frequency, through a prefix filter, which is exact for two such sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkmesh.llm.common import expand, hamming, max_difference
from inkmesh.operators.blocks import meet
from inkmesh.session import cut, cut_round, skew_join

HOT, SLACK, WORDS = 64, 1.5, 8
_SK = [f"s{w}" for w in range(WORDS)]


def shingles(words: Column, width: int) -> Column:
    """Distinct hashes of all runs of ``width`` words of an array, sorted."""
    starts = F.sequence(F.lit(0), F.size(words) - width)
    return F.array_sort(F.array_distinct(F.transform(starts, lambda i: F.xxhash64(*(F.get(words, i + k) for k in range(width))))))


def classes(texts: DataFrame, width: int) -> tuple[DataFrame, DataFrame]:
    """From (id, text): (reps: rep, size, h), (members: rep, id), by equal shingle sets."""
    w = F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)).alias("w")
    base = texts.where("id is not null and text is not null").select("id", w)
    base = base.select("id", F.when(F.size("w") >= width, shingles(F.col("w"), width)).alias("h"))
    fp = F.concat_ws("-", F.hex(F.xxhash64("h")), F.hex(F.xxhash64(F.lit(1), "h")), F.size("h"))
    base = cut(base.withColumn("fp", fp)).where("h is not null")
    reps = cut(base.groupBy("fp").agg(F.min("id").alias("rep"), F.first("h").alias("h"), F.count(F.lit(1)).alias("n")))
    members = skew_join(base.select("fp", "id"), reps.select("fp", "rep", "n"), "fp", "n", "id")
    return reps.select("rep", F.size("h").alias("size"), "h"), members.select("rep", "id")


def level_of(size: int, tau: float) -> int:
    return math.floor(math.log(size) / math.log(1 / tau) + 1e-9)


def level_plan(level: int, tau: float) -> tuple[int, int]:
    """(largest size of the band, number of blocks of the level)."""
    top = math.ceil((1 / tau) ** (level + 1))
    while level_of(top, tau) > level:
        top -= 1
    widest = math.floor((top + math.floor(top / tau + 1e-9)) * (1 - tau) / (1 + tau) + 1e-9)
    return top, math.ceil(SLACK * (widest + 1)) + 1


def parity_sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rep, size, s0, s1, ...) of sets (rep, h): every token flips one of 64 * WORDS bits."""
    for batch in batches:
        lists = batch.column("h")
        tokens = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
        sizes = np.diff(lists.offsets.to_numpy())
        place = np.repeat(np.arange(len(sizes)), sizes) * WORDS + ((tokens >> np.uint64(40)) % np.uint64(WORDS)).astype(np.int64)
        words = np.zeros(len(sizes) * WORDS, dtype=np.uint64)
        np.bitwise_xor.at(words, place, np.uint64(1) << ((tokens >> np.uint64(8)) % np.uint64(64)))
        words = words.view(np.int64).reshape(-1, WORDS)
        cols = [batch.column("rep"), pa.array(sizes, pa.int32()), *(pa.array(words[:, k]) for k in range(WORDS))]
        yield pa.RecordBatch.from_arrays(cols, names=["rep", "size", *_SK])


def block_keys(batches: Iterator[pa.RecordBatch], tau: float) -> Iterator[pa.RecordBatch]:
    """(rep, band, slack, key) of every non-empty block of sets (rep, size, h); band is 2 * level + own.

    A set belongs to its own band as the smaller side and to the band below as the larger
    one. ``slack`` = B - D less the set's empty blocks: so many blocks that hold tokens agree
    with any similar set. Where that is none, one row without key says so.
    """
    for batch in batches:
        reps, sizes = batch.column("rep").to_numpy(), batch.column("size").to_numpy()
        lists = batch.column("h")
        tokens = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
        owner = np.repeat(np.arange(len(reps)), sizes)
        own = np.array([level_of(int(s), tau) for s in sizes], dtype=np.int64)
        for below in (0, 1):
            level = own - below
            plans = {lv: level_plan(lv, tau) for lv in set(level.tolist()) if lv >= 0}
            top = np.array([plans.get(lv, (0, 1))[0] for lv in level.tolist()])
            blocks = np.array([plans.get(lv, (0, 1))[1] for lv in level.tolist()], dtype=np.uint64)
            partner = np.where(below, np.minimum(top, sizes), np.floor(sizes / tau + 1e-9).astype(np.int64))
            most = np.floor((sizes + partner) * (1 - tau) / (1 + tau) + 1e-9).astype(np.int64)
            room = blocks.astype(np.int64) - most
            meets = (level >= 0) & (not below or np.floor(top / tau + 1e-9) >= sizes)
            use = meets[owner]
            t, o = tokens[use], owner[use]
            if not len(t):
                continue
            block = (t >> np.uint64(16)) % blocks[o]
            order = np.lexsort((block, o))
            t, o, block = t[order], o[order], block[order]
            first = np.flatnonzero(np.r_[True, (o[1:] != o[:-1]) | (block[1:] != block[:-1])])
            xor, who, block = np.bitwise_xor.reduceat(t, first), o[first], block[first]
            empty = blocks.astype(np.int64) - np.bincount(who, minlength=len(reps))
            slack = room - empty
            with np.errstate(over="ignore"):
                key = (xor ^ (block * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xBF58476D1CE4E5B9)
                key ^= level[who].astype(np.uint64) * np.uint64(0x94D049BB133111EB)
            none = np.flatnonzero(meets & (slack <= 0))
            row = np.r_[who, none]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(reps[row]),
                    pa.array((2 * level[row] + (not below)).astype(np.int32)),
                    pa.array(slack[row].astype(np.int32)),
                    pa.array(np.r_[key.view(np.int64), np.zeros(len(none), dtype=np.int64)], mask=np.arange(len(row)) >= len(who)),
                ],
                names=["rep", "band", "slack", "key"],
            )


def _close(tau: float) -> Column:
    return F.least("a_size", "b_size") >= F.greatest("a_size", "b_size") * F.lit(tau) - 1e-9


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a_rep").alias("a"), F.col("b_rep").alias("b"))


def prefix_candidates(unlucky: DataFrame, reps: DataFrame, tau: float) -> DataFrame:
    """Exact candidates among sets (rep, band): their rarest tokens must meet."""
    t = unlucky.join(reps, "rep").select("rep", F.shiftright("band", 1).alias("level"), "size", F.explode("h").alias("t"))
    t = t.withColumn("key", F.xxhash64("level", "t"))
    df = t.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    t = skew_join(t, df.withColumn("k", F.col("n")), "key", "k", "rep")
    rank = F.row_number().over(Window.partitionBy("rep", "level").orderBy("n", "t"))
    head = F.col("size") - F.ceil(F.col("size") * F.lit(tau) - 1e-9) + 1
    kept = t.withColumn("r", rank).where((F.col("r") <= head) & (F.col("n") > 1))
    return _ends(meet(kept, "key", "n", "rep", ["size"], _close(tau))).distinct()


def candidates(reps: DataFrame, tau: float) -> DataFrame:
    """Distinct (a, b) of classes that agree in one of the blocks in which similar ones must."""
    schema = "rep bigint, band int, slack int, key bigint"
    every = reps.select("rep", "size", "h").mapInArrow(lambda it: block_keys(it, tau), schema)
    keys = every.where("key is not null")
    counts = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    live = skew_join(keys, counts.withColumn("k", F.col("n")), "key", "k", "rep")
    own = Window.partitionBy("rep", "band")
    ranked = live.select("*", F.row_number().over(own.orderBy("n", "key")).alias("r"), F.count(F.lit(1)).over(own).alias("live"))
    # Not live are the blocks that no other set has; with fewer live ones than must agree there is no partner.
    ranked = cut(ranked.where(F.col("r") <= F.col("live") - F.col("slack") + 1))
    cold = ranked.where(F.col("n") <= HOT).select("rep", "band", "key")
    again = cold.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    cold = skew_join(cold, again.withColumn("k", F.col("n")), "key", "k", "rep")
    met = meet(cold, "key", "n", "rep", ["band"], F.col("a_band").bitwiseOR(F.col("b_band")) % 2 == 1)
    # Blocks are ranked with the hot ones last: a hot key among the first ones says that too few others must agree.
    hot = ranked.where(F.col("n") > HOT).select("rep", "band")
    unlucky = every.where("key is null").select("rep", "band").unionByName(hot).distinct()
    return _ends(met).unionByName(prefix_candidates(cut(unlucky), reps, tau)).distinct()


def similar_classes(reps: DataFrame, tau: float) -> DataFrame:
    """(a, b, score) of classes with Jaccard >= tau."""
    pairs = cut(candidates(reps, tau))
    named = pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct()
    schema = "rep bigint, size int, " + ", ".join(f"{c} bigint" for c in _SK)
    facts = cut(reps.join(named, "rep", "left_semi").select("rep", "h").mapInArrow(parity_sketches, schema))
    side = lambda p: facts.select(F.col("rep").alias(p), *(F.col(c).alias(f"{p}_{c}") for c in ("size", *_SK)))
    both = pairs.join(side("a"), "a").join(side("b"), "b").where(_close(tau))
    both = both.where(hamming(WORDS) <= max_difference(F.col("a_size"), F.col("b_size"), tau))
    near = both.select("a", "b")
    full = near.join(reps.select(F.col("rep").alias("a"), F.col("h").alias("a_h")), "a").join(reps.select(F.col("rep").alias("b"), F.col("h").alias("b_h")), "b")
    score = F.col("i") / (F.size("a_h") + F.size("b_h") - F.col("i"))
    return full.withColumn("i", F.size(F.array_intersect("a_h", "b_h"))).select("a", "b", score.alias("score")).where(F.col("score") >= tau)


def near_duplicate_pairs(texts: DataFrame, tau: float = 0.7, width: int = 3) -> DataFrame:
    """(a, b), a < b, of all records (id, text) whose shingle sets reach ``tau``.

    Null ids and texts and texts of fewer than ``width`` words are never a case. Texts are
    taken whole. A record delivered twice counts once; an empty table gives no rows.
    """
    reps, members = classes(texts, width)
    return expand(similar_classes(reps, tau).select("a", "b"), members)


def near_duplicate_groups(texts: DataFrame, tau: float = 0.7, width: int = 3) -> DataFrame:
    """(id, class_id, group_id, copies, linked): groups are connected components of the links.

    Components by hash-to-minimum label exchange with pointer jumping, checkpointed each round.
    """
    reps, members = classes(texts, width)
    pairs = cut(similar_classes(reps, tau).select("a", "b"))
    label = components(reps.select("rep"), pairs)
    linked = pairs.select(F.col("a").alias("rep")).unionByName(pairs.select(F.col("b").alias("rep"))).groupBy("rep").count()
    own = members.distinct().groupBy("rep").agg(F.count(F.lit(1)).alias("copies"))
    facts = own.join(label, "rep").join(linked.withColumnRenamed("count", "linked"), "rep", "left")
    return (
        members.distinct()
        .join(facts, "rep")
        .select("id", F.col("rep").alias("class_id"), F.col("label").alias("group_id"), "copies", F.coalesce("linked", F.lit(0)).alias("linked"))
    )


def components(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(rep, label): the smallest id of each connected component."""
    edges = cut(pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    label = cut(nodes.select("rep", F.col("rep").alias("label")))
    while True:
        near = edges.join(label.select(F.col("rep").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("m"))
        moved = label.join(near, label["rep"] == near["a"], "left").select("rep", F.col("label").alias("old"), F.least("label", "m").alias("label"))
        jump = moved.select(F.col("rep").alias("_r"), F.col("label").alias("_l"))
        moved = moved.join(jump, moved["label"] == F.col("_r"), "left").select("rep", "old", F.least("label", "_l").alias("label"))
        moved = cut_round(moved)
        if moved.where("label <> old").isEmpty():
            return moved.select("rep", "label")
        label = moved.select("rep", "label")
