"""Evaluation texts leaking into training text (problem 7).

N-gram seeds join corpus passages to test items, Smith-Waterman alignment scores what meets. One
pass over the corpus keeps the passages around places where SEED consecutive words are
consecutive in some item; an item with fewer words is one seed as a whole. No seed is dropped,
however many documents hold it (those that very many hold are salted in the join), so that
copies of a file do not hide its leaks. Each (passage, item) is then aligned word by word.

The items are read in blocks of BLOCK_CHARS characters, each a pass over the corpus of its own;
only a block is ever held by a task.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkmesh.llm.subtitles import spoken, words
from inkmesh.session import cut, skew_join

SEED, RUN, BLOCK_CHARS = 5, 12, 8_000_000
#: No cut by document frequency.
RARE_DF = None
MATCH, MISMATCH, GAP = 2, -1, -1
_BASE = 0x9E3779B97F4A7C15


@dataclass
class Items:
    """A block of test items as word numbers, and the sorted hashes of their runs."""

    seed: int
    run: int
    ids: list[int] = field(default_factory=list)
    texts: list[np.ndarray] = field(default_factory=list)
    vocabulary: dict[str, int] = field(default_factory=dict)

    def add(self, item_id: int, text: str) -> None:
        v = self.vocabulary
        self.ids.append(item_id)
        self.texts.append(np.array([v.setdefault(w, len(v) + 1) for w in words(text)], dtype=np.int64))

    def index(self, runs: bool) -> list[tuple[int, int]]:
        """(gram, item_id) postings; sorts the hashes of seeds, and of whole ``runs`` where asked, for lookup."""
        posts: dict[int, set[int]] = defaultdict(set)
        short = {len(t) for t in self.texts if 0 < len(t) < self.seed}
        own = (self.seed, self.run) if runs else (self.seed,)
        self.widths = sorted({*own, *short})
        for item, t in zip(self.ids, self.texts, strict=True):
            for n in own if len(t) >= self.seed else (len(t),):
                for g in grams(t, n)[0].view(np.int64).tolist():
                    posts[g].add(item)
        self.known = np.sort(np.array(list(posts), dtype=np.int64))
        self.longest = max((len(t) for t in self.texts), default=0)
        return [(g, i) for g, s in posts.items() for i in s]


def grams(ids: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of n known words (number > 0) and their places."""
    m = len(ids) - n + 1
    if m <= 0:
        return np.array([], dtype=np.uint64), np.array([], dtype=np.int64)
    with np.errstate(over="ignore"):
        h = np.full(m, n, dtype=np.uint64)
        ok = np.ones(m, dtype=bool)
        for k in range(n):
            part = ids[k : k + m]
            ok &= part > 0
            h = (h ^ (h >> np.uint64(29))) * np.uint64(_BASE) + part.astype(np.uint64)
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    at = np.flatnonzero(ok)
    return h[at], at


def passages(batches: Iterator[pa.RecordBatch], items: Items) -> Iterator[pa.RecordBatch]:
    """(doc_id, start, words, grams) of the places of documents (doc_id, text) with seeds."""
    get, pad = items.vocabulary.get, max(2 * items.longest, items.run)
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int32()), ("words", pa.list_(pa.int32())), ("grams", pa.list_(pa.int64()))])
    for batch in batches:
        ids, bounds, docs = [], [0], batch.column("doc_id").to_pylist()
        for text in batch.column("text").to_pylist():
            ids.extend([get(w, 0) for w in words(spoken(text))])
            ids.append(0)
            bounds.append(len(ids))
        ids, bounds = np.array(ids, dtype=np.int64), np.array(bounds)
        found, places = [], []
        for n in items.widths:
            h, at = grams(ids, n)
            h = h.view(np.int64)
            k = np.minimum(np.searchsorted(items.known, h), len(items.known) - 1)
            hit = items.known[k] == h
            found.append(h[hit])
            places.append(at[hit])
        g, at = np.concatenate(found), np.concatenate(places)
        order = np.argsort(at, kind="stable")
        g, at = g[order], at[order]
        doc = np.searchsorted(bounds, at, side="right") - 1
        out: list[list] = [[], [], [], []]
        if len(at):
            new = np.r_[True, (doc[1:] != doc[:-1]) | (at[1:] - at[:-1] > pad)]
            first = np.r_[np.flatnonzero(new), len(at)]
            for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
                d = int(doc[a])
                lo, hi = max(bounds[d], at[a] - pad), min(bounds[d + 1] - 1, at[b - 1] + items.run + pad)
                for c, x in zip(out, (docs[d], int(lo - bounds[d]), ids[lo:hi].tolist(), np.unique(g[a:b]).tolist()), strict=True):
                    c.append(x)
        yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(out, schema, strict=True)], schema=schema)


def align(passage: np.ndarray, item: np.ndarray) -> tuple[int, int, int, int]:
    """(longest common run, Smith-Waterman score, passage end of the best alignment, its item end)."""
    m = len(passage)
    h, run = np.zeros(m + 1, dtype=np.int64), np.zeros(m + 1, dtype=np.int64)
    ramp = -GAP * np.arange(m + 1)
    best = (0, 0, 0)
    longest = 0
    for i, w in enumerate(item.tolist(), 1):
        same = passage == w
        run[1:] = np.where(same, run[:-1] + 1, 0)
        row = np.maximum(h + GAP, 0)
        row[1:] = np.maximum(row[1:], h[:-1] + np.where(same, MATCH, MISMATCH))
        h = np.maximum.accumulate(row + ramp) - ramp
        longest = max(longest, int(run.max()))
        j = int(h.argmax())
        if h[j] > best[0]:
            best = (int(h[j]), j, i)
    return longest, *best


def aligned(batches: Iterator[pa.RecordBatch], items: Items) -> Iterator[pa.RecordBatch]:
    """Scores of (doc_id, start, words, item_id)."""
    texts = dict(zip(items.ids, items.texts, strict=True))
    for batch in batches:
        rows = []
        for d, s, w, i in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "start", "words", "item_id")), strict=True):
            longest, score, end, _ = align(np.array(w, dtype=np.int64), texts[i])
            rows.append((d, i, s + end, longest, score, score / (MATCH * max(1, len(texts[i])))))
        cols = list(zip(*rows, strict=True)) or [[]] * 6
        types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.float64()]
        names = ["doc_id", "item_id", "ends_at", "longest_run", "score", "share"]
        yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(cols, types, strict=True)], names=names)


def _blocks(benchmark: DataFrame, seed: int, run: int) -> Iterator[Items]:
    rows = benchmark.where("item_id is not null and text is not null").select("item_id", "text").dropDuplicates(["item_id"])
    block, chars = Items(seed, run), 0
    for r in rows.orderBy("item_id").toLocalIterator():
        if chars and chars + len(r["text"]) > BLOCK_CHARS:
            yield block
            block, chars = Items(seed, run), 0
        block.add(r["item_id"], r["text"])
        chars += len(r["text"])
    if chars:
        yield block


def leaks(documents: DataFrame, benchmark: DataFrame, seed: int = SEED, run: int = RUN, rare_df: int | None = RARE_DF) -> DataFrame:
    """(doc_id, item_id, longest_run, score, share, ends_at): the best alignment per document and item.

    ``share`` is the score as a part of a perfect one; ``ends_at`` the spoken word after the
    best alignment. Null ids or texts are left out, texts without words have no rows, repeated
    rows count once, empty tables give no rows, other columns are ignored. With ``rare_df`` only
    runs of ``run`` words and seeds in at most so many documents count.
    """
    spark, parts = documents.sparkSession, []
    docs = documents.where("doc_id is not null and text is not null").select("doc_id", "text")
    for items in _blocks(benchmark, seed, run):
        posts = items.index(rare_df is not None)  # seeds of any frequency find every run
        if not posts:
            continue
        schema = "doc_id bigint, start int, words array<int>, grams array<bigint>"
        found = cut(docs.mapInArrow(lambda it, x=items: passages(it, x), schema))
        each = found.select("doc_id", "start", F.explode("grams").alias("gram"))
        df = each.select("doc_id", "gram").distinct().groupBy("gram").agg(F.count(F.lit(1)).alias("df"))
        runs = {g for t in items.texts for g in grams(t, run)[0].view(np.int64).tolist()}
        post = spark.createDataFrame([(g, i, g in runs) for g, i in posts], "gram bigint, item_id bigint, whole boolean")
        kept = df.join(post, "gram")
        if rare_df is not None:
            kept = kept.where(F.col("whole") | (F.col("df") <= rare_df))
        kept = kept.groupBy("gram", "df").agg(F.collect_list("item_id").alias("items"))  # at most a block's items
        met = skew_join(each, kept, "gram", "df", "doc_id")
        pairs = met.select("doc_id", "start", F.explode("items").alias("item_id")).distinct()
        rows = pairs.join(found.select("doc_id", "start", "words").dropDuplicates(["doc_id", "start"]), ["doc_id", "start"])
        out = "doc_id bigint, item_id bigint, ends_at int, longest_run int, score int, share double"
        parts.append(rows.select("doc_id", "start", "words", "item_id").mapInArrow(lambda it, x=items: aligned(it, x), out))
    if not parts:
        return spark.createDataFrame([], "doc_id bigint, item_id bigint, longest_run int, score int, share double, ends_at int")
    all_of = parts[0]
    for p in parts[1:]:
        all_of = all_of.unionByName(p)
    best = F.max(F.struct("score", F.negate("ends_at").alias("e"))).alias("m")
    return all_of.groupBy("doc_id", "item_id").agg(F.max("longest_run").alias("longest_run"), best, F.max("share").alias("share")).select(
        "doc_id", "item_id", "longest_run", F.col("m.score").alias("score"), "share", F.negate("m.e").alias("ends_at")
    )
