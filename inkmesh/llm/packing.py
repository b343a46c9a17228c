"""Filling fixed-capacity containers with items (problem 6): grouping genetic algorithm.

A text is as long as its tokens; longer than a container, it is cut into full containers and a
rest. Items are dealt to shards of about SHARD items by hash, and ISLANDS populations evolve
for each shard, every one in a task of its own. A solution is a grouping of items into bins.
Crossover injects well-filled bins of one parent into a copy of the other, drops the bins that
hold any of their items, lets displaced items replace smaller ones where they fill a bin better,
and puts the rest back by best fit, longest first. After each
of EPOCHS epochs an island's elite migrates to the next island of its shard. Bins that are not
well filled go to another level, where the rests of all shards are dealt to fewer shards and
packed again, until one shard is left or a level needs no fewer containers for the same items;
so the unused space does not grow with the shards.
"""

from __future__ import annotations

import base64
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkmesh.session import cut

CAPACITY, SHARD, ISLANDS, EPOCHS = 4096, 4000, 3, 3
POPULATION, GENERATIONS, WELL_FILLED, SWAPS = 8, 40, 0.998, 24
#: Levels of packing end when one lowers the number of containers by no more than this part.
LEAST_GAIN = 0.001
VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


@lru_cache(maxsize=2)
def _encoding(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def _measured(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    encode = _encoding(path).encode_ordinary
    for batch in batches:
        n = [len(encode(t.encode("utf-8", "replace").decode())) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64())], names=["doc_id", "tokens"])


def token_counts(documents: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, tokens) of whole texts."""
    path = path or vocabulary_path()
    docs = documents.where("doc_id is not null and text is not null").select("doc_id", "text")
    return docs.mapInArrow(lambda it: _measured(it, path), "doc_id bigint, tokens bigint")


def pieces(counts: DataFrame, capacity: int) -> DataFrame:
    """(doc_id, piece, start, size): whole texts, or full pieces and a rest of longer ones."""
    n = F.greatest(F.ceil(F.col("tokens") / capacity), F.lit(1)).cast("int")
    start = F.col("piece").cast("bigint") * capacity
    each = counts.withColumn("piece", F.explode(F.sequence(F.lit(0), n - 1)))
    return each.select("doc_id", "piece", start.alias("start"), F.least(F.col("tokens") - start, F.lit(capacity)).cast("int").alias("size"))


class Grouping:
    """Bins of items: ``bin`` of each item and ``fill`` of each bin."""

    __slots__ = ("bin", "fill")

    def __init__(self, bin_of: np.ndarray, sizes: np.ndarray) -> None:
        used, self.bin = np.unique(bin_of, return_inverse=True)
        self.fill = np.bincount(self.bin, weights=sizes, minlength=len(used)).astype(np.int64)

    def fitness(self, capacity: int) -> float:
        """Falkenauer's: mean square of the fill."""
        return float(np.square(self.fill / capacity).mean())


def best_fit(bin_of: np.ndarray, fill: list[int], items: np.ndarray, sizes: np.ndarray, capacity: int) -> None:
    """Put items, in the given order, into the fullest bins that have room; changes bin_of and fill."""
    room = sorted((capacity - f, b) for b, f in enumerate(fill) if f < capacity)
    for i in items.tolist():
        s = int(sizes[i])
        k = bisect_left(room, (s, -1))
        if k < len(room):
            r, b = room.pop(k)
            fill[b] += s
        else:
            r, b = capacity, len(fill)
            fill.append(s)
        bin_of[i] = b
        if r > s:
            insort(room, (r - s, b))


def _sets(at: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sums, first, second) of all single items and pairs of ``at``, by rising sum; second -1 for singles."""
    i, j = np.triu_indices(len(at), 1)
    sums = np.r_[sizes[at], sizes[at[i]] + sizes[at[j]]]
    order = np.argsort(sums, kind="stable")
    return sums[order], np.r_[at, at[i]][order], np.r_[np.full(len(at), -1), at[j]][order]


def swap_in(bin_of: np.ndarray, fill: list[int], out: np.ndarray, sizes: np.ndarray, capacity: int, rng: np.random.Generator) -> np.ndarray:
    """Dominance: in some bins, one or two items give way to one or two displaced ones that fill them better.

    Changes bin_of and fill; gives the items that are displaced afterwards. The swapped-out items
    are smaller together, so that they are easier to place.
    """
    open_bins = np.flatnonzero(np.asarray(fill) < capacity)
    if not len(open_bins) or not len(out):
        return out
    bins = rng.choice(open_bins, size=min(SWAPS, len(open_bins)), replace=False)
    order = np.argsort(bin_of, kind="stable")
    lo, hi = np.searchsorted(bin_of[order], bins), np.searchsorted(bin_of[order], bins, side="right")
    for b, x, y in zip(bins.tolist(), lo.tolist(), hi.tolist(), strict=True):
        near = out if len(out) <= 48 else out[rng.choice(len(out), 48, replace=False)]
        sums, f, g = _sets(near, sizes)
        less, p, q = _sets(order[x:y], sizes)
        k = np.searchsorted(sums, less + capacity - fill[b], side="right") - 1
        gain = np.where(k >= 0, sums[np.maximum(k, 0)] - less, 0)
        m = int(gain.argmax())
        if gain[m] <= 0:
            continue
        came = [i for i in (int(f[k[m]]), int(g[k[m]])) if i >= 0]
        went = [i for i in (int(p[m]), int(q[m])) if i >= 0]
        bin_of[came], bin_of[went] = b, -1
        fill[b] += int(gain[m])
        out = np.r_[out[~np.isin(out, came)], went]
    return out


def first_groupings(sizes: np.ndarray, capacity: int, n: int, rng: np.random.Generator) -> list[Grouping]:
    out = []
    for k in range(n):
        noise = 1.0 if not k else rng.uniform(1 - 0.3 * k / n, 1.0, len(sizes))
        order = np.argsort(-sizes * noise, kind="stable")
        bin_of, fill = np.full(len(sizes), -1, dtype=np.int64), []
        best_fit(bin_of, fill, order, sizes, capacity)
        out.append(Grouping(bin_of, sizes))
    return out


def crossover(a: Grouping, donor: Grouping, sizes: np.ndarray, capacity: int, rng: np.random.Generator) -> Grouping:
    good = np.flatnonzero(donor.fill >= WELL_FILLED * capacity)
    if not len(good):
        good = np.argsort(-donor.fill)[: max(1, len(donor.fill) // 4)]
    take = rng.choice(good, size=int(rng.integers(1, max(2, min(len(good), 24) + 1))), replace=False)
    chosen = np.zeros(len(donor.fill), dtype=bool)
    chosen[take] = True
    injected = chosen[donor.bin]
    dropped = np.zeros(len(a.fill), dtype=bool)
    dropped[a.bin[injected]] = True
    # The emptiest bins go too: only so can the number of bins fall.
    dropped[np.argsort(a.fill)[: int(rng.integers(1, 4))]] = True
    displaced = np.flatnonzero(dropped[a.bin] & ~injected)
    bin_of = a.bin + len(donor.fill)
    bin_of[injected] = donor.bin[injected]
    bin_of[displaced] = -1
    kept = np.flatnonzero(bin_of >= 0)
    _, at = np.unique(bin_of[kept], return_inverse=True)
    bin_of[kept] = at
    fill = np.bincount(at, weights=sizes[kept]).astype(np.int64).tolist() if len(kept) else []
    displaced = swap_in(bin_of, fill, displaced, sizes, capacity, rng)
    best_fit(bin_of, fill, displaced[np.argsort(-sizes[displaced], kind="stable")], sizes, capacity)
    return Grouping(bin_of, sizes)


def evolve(sizes: np.ndarray, capacity: int, seed: int, elites: list[np.ndarray], generations: int) -> tuple[np.ndarray, float]:
    """Best grouping of one island after some generations, from its elites or afresh."""
    rng = np.random.default_rng(seed)
    people = [Grouping(e, sizes) for e in elites]
    people += first_groupings(sizes, capacity, max(POPULATION - len(people), 2), rng)
    scores = [p.fitness(capacity) for p in people]
    least = -(-int(sizes.sum()) // capacity)
    for _ in range(generations):
        i, j = rng.choice(len(people), 2, replace=False)
        if scores[j] > scores[i]:
            i, j = j, i
        child = crossover(people[i], people[j], sizes, capacity, rng)
        s, worst = child.fitness(capacity), int(np.argmin(scores))
        if s > scores[worst]:
            people[worst], scores[worst] = child, s
        if len(people[int(np.argmax(scores))].fill) <= least and max(scores) > 0.9999:
            break
    best = int(np.argmax(scores))
    return people[best].bin, scores[best]


_ITEMS = ["size", "doc_id", "piece"]
_ELITE = "shard bigint, island int, fitness double, bins array<int>"


def _ordered(pdf: pd.DataFrame) -> pd.DataFrame:
    return pdf.sort_values(_ITEMS, ascending=[False, True, True], kind="stable")


def _island(capacity: int, generations: int, epoch: int):
    """One epoch of one island: its items and the elites it starts from."""

    def run(pdf: pd.DataFrame, came: list) -> pd.DataFrame:
        shard, island = int(pdf["shard"].iloc[0]), int(pdf["island"].iloc[0])
        sizes = _ordered(pdf)["size"].to_numpy(dtype=np.int64)
        seed = (shard * 1_000_003 + island * 1009 + epoch) & 0x7FFFFFFF
        bins, fitness = evolve(sizes, capacity, seed, [np.asarray(b, dtype=np.int64) for b in came], generations)
        return pd.DataFrame({"shard": [shard], "island": [island], "fitness": [fitness], "bins": [bins.astype(np.int32)]})

    return run


def pack_shards(items: DataFrame, capacity: int, islands: int = ISLANDS, epochs: int = EPOCHS, generations: int = GENERATIONS) -> DataFrame:
    """(shard, doc_id, piece, size, bin, fill) of items (shard, doc_id, piece, size)."""
    each = items.select("shard", *_ITEMS).withColumn("island", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))))
    elites: DataFrame | None = None
    for epoch in range(epochs):
        run = _island(capacity, generations, epoch)
        if elites is None:
            made = each.groupBy("shard", "island").applyInPandas(lambda pdf: run(pdf, []), _ELITE)
        else:
            # A ring: every island keeps its own elite and gets that of the island before.
            moved = elites.withColumn("island", F.explode(F.array_distinct(F.array("island", F.pmod(F.col("island") + 1, F.lit(islands))))))
            both = each.groupBy("shard", "island").cogroup(moved.groupBy("shard", "island"))
            made = both.applyInPandas(lambda pdf, came: run(pdf, list(came.sort_values("fitness")["bins"])), _ELITE)
        elites = cut(made)
    best = elites.groupBy("shard").agg(F.max_by("bins", F.struct("fitness", F.negate("island"))).alias("bins"))

    def place(pdf: pd.DataFrame, won: pd.DataFrame) -> pd.DataFrame:
        pdf = _ordered(pdf)
        pdf["bin"] = np.asarray(won["bins"].iloc[0], dtype=np.int64)
        pdf["fill"] = pdf.groupby("bin")["size"].transform("sum")
        return pdf[["shard", "doc_id", "piece", "size", "bin", "fill"]]

    schema = "shard bigint, doc_id bigint, piece int, size int, bin bigint, fill bigint"
    return items.select("shard", *_ITEMS).groupBy("shard").cogroup(best.groupBy("shard")).applyInPandas(place, schema)


def _shards(items: DataFrame, n: int, level: int) -> DataFrame:
    return items.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", F.lit(level)), F.lit(n)))


def pack(counts: DataFrame, capacity: int = CAPACITY, shard: int = SHARD) -> DataFrame:
    """(doc_id, piece, start, size, container, used, unused) of texts (doc_id, tokens).

    Texts of no token take no space and have a null container; nulls and negative sizes are
    left out; a text counted twice is packed once; an empty table gives no rows. Only texts
    longer than a container are split. ``container`` is unique over all levels and shards.
    """
    known = counts.where("doc_id is not null and tokens >= 0").groupBy("doc_id").agg(F.max("tokens").alias("tokens"))
    every = cut(pieces(known, capacity))
    none = every.where("size = 0").withColumn("container", F.lit(None).cast("string")).withColumn("used", F.lit(0).cast("bigint"))
    full = every.where(F.col("size") == capacity)
    full = full.withColumn("container", F.concat_ws("-", F.lit("f"), "doc_id", "piece")).withColumn("used", F.col("size").cast("bigint"))
    parts = [none, full]
    rest, level, before = every.where((F.col("size") > 0) & (F.col("size") < capacity)), 0, None
    n = rest.count()
    while n:
        shards = -(-n // shard)
        placed = cut(pack_shards(_shards(rest, shards, level), capacity))
        placed = placed.join(every.select("doc_id", "piece", "start"), ["doc_id", "piece"])
        well = F.col("fill") >= F.lit(WELL_FILLED * capacity)
        bins = placed.groupBy("shard", "bin").agg(F.count(F.lit(1)).alias("items"), F.first("fill").alias("fill"))
        facts = bins.agg(F.count(F.lit(1)), F.count_if(~well), F.sum(F.when(~well, F.col("items")))).first()
        last = shards == 1 or (before is not None and facts[0] > (1 - LEAST_GAIN) * before)
        done = F.lit(True) if last else well
        label = F.concat_ws("-", F.lit(level), "shard", "bin")
        parts.append(placed.where(done).select("doc_id", "piece", "start", "size", label.alias("container"), F.col("fill").alias("used")))
        if last:
            break
        rest, before, n, level = cut(placed.where(~well).select("doc_id", "piece", "start", "size")), facts[1], facts[2] or 0, level + 1
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p.select(*out.columns))
    unused = F.when(F.col("container").isNotNull(), F.lit(capacity) - F.col("used"))
    return out.select("doc_id", "piece", "start", "size", "container", "used", unused.alias("unused"))


def summary(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: items, containers, least possible containers, tokens, unused tokens and their part."""
    each = packed.where("container is not null").groupBy("container").agg(F.count(F.lit(1)).alias("items"), F.sum("size").alias("used"))
    total = F.sum("used")
    return each.agg(
        F.sum("items").alias("items"),
        F.count(F.lit(1)).alias("containers"),
        F.ceil(total / capacity).alias("least_containers"),
        total.alias("tokens"),
        F.sum(F.lit(capacity) - F.col("used")).alias("unused"),
        (F.sum(F.lit(capacity) - F.col("used")) / (F.count(F.lit(1)) * capacity)).alias("unused_part"),
    )
