"""Long exact spans shared between records (problem 1): compact windows.

The tokens of a text are its runs of ``gram`` characters, ordered by a hash. The Cartesian tree
over the hashes of a text groups all its subsequences by their smallest token: a node (l, c, r)
stands for every subsequence of [l, r] that contains c, all of which have the token at c as their
min-hash. Nodes narrower than the tokens of a span of the wanted length are left out, about 2 in
(span - gram + 1) positions remain; l and r are kept up to the width of a span, which a node of
any greater width holds too. A span that two texts share has the same leftmost smallest token in
both, so it lies in a window of each, with the same token at the same offset: for verbatim spans
one hash finds every pair, more hashes would only be needed for altered spans.

Windows that share a token meet by an interval join: what [l, r] leaves on both sides of the
centres must be wide enough together. They meet by *form*, i.e. the characters of the window:
equal forms are one, forms of one token are compared by their common characters to both sides,
and a token with more than HOT forms is split by the exact spans through its centre instead, so
that only pairs that share one meet.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkmesh.llm.common import across, expand, within
from inkmesh.operators.blocks import meet
from inkmesh.session import cut, skew_join

GRAM, HOT = 100, 64
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))


def token_hashes(codes: np.ndarray, gram: int) -> np.ndarray:
    """Mixed 64-bit hashes of all runs of ``gram`` code points."""
    n = len(codes) - gram + 1
    with np.errstate(over="ignore"):
        power = np.cumprod(np.r_[np.uint64(1), np.full(len(codes), _BASE)])
        back = np.cumprod(np.r_[np.uint64(1), np.full(n - 1, _INV)])
        sums = np.r_[np.uint64(0), np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * power[:-1])]
        h = (sums[gram:] - sums[:n]) * back
        h ^= h >> np.uint64(31)
        h *= np.uint64(0x7FB5D329728EA185)
        h ^= h >> np.uint64(27)
        h *= np.uint64(0x81DADEF4BC2DD44D)
        return h ^ (h >> np.uint64(33))


def span_gram(span: int, gram: int | None) -> int:
    """Length of tokens: as given, else two thirds of a span, GRAM at most."""
    gram = min(GRAM, -(-2 * span // 3)) if gram is None else gram
    if not 1 <= gram <= span:
        raise ValueError("span must be positive, and gram between 1 and span")
    return gram


def range_minima(order: np.ndarray, width: int) -> list[np.ndarray]:
    """Level j: the minima of all 2 ** j neighbours, for powers up to ``width``."""
    levels = [order]
    while 2 ** len(levels) <= width and len(levels[-1]) > 2 ** (len(levels) - 1):
        low, have = levels[-1], 2 ** (len(levels) - 1)
        levels.append(np.minimum(low[:-have], low[have:]))
    return levels


def window_minima(levels: list[np.ndarray], width: int) -> np.ndarray:
    """The minima of all ``width`` neighbours."""
    j = width.bit_length() - 1
    rest = width - (1 << j)
    if j >= len(levels) or len(levels[j]) <= rest:
        return levels[0][:0]
    return np.minimum(levels[j][: len(levels[j]) - rest], levels[j][rest:])


def tree_reach(levels: list[np.ndarray], at: np.ndarray, most: np.ndarray, step: int) -> np.ndarray:
    """How far the Cartesian tree's nodes at places ``at`` reach to one side (step -1 or 1), ``most`` at most.

    A node reaches to the next smaller token, found by ever shorter jumps over range minima.
    """
    reach, own = np.zeros(len(at), dtype=np.int64), levels[0][at]
    for j in reversed(range(len(levels))):
        size = 1 << j
        first = at + reach + 1 if step > 0 else at - reach - size
        fits = reach + size <= most
        low = levels[j][np.clip(first, 0, len(levels[j]) - 1)]
        reach += np.where(fits & (low > own), size, 0)
    return reach


_PLACE = np.uint64(24)  # bits of a place in CHUNK texts' tokens; the rest of the order is hash
CHUNK = 1 << 20


def _chunk_windows(reps: list[int], texts: list[str], span: int, gram: int) -> tuple[np.ndarray, ...]:
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    h, width = token_hashes(codes, gram), span - gram + 1
    place = np.arange(len(h), dtype=np.uint64)
    ends = np.cumsum([len(t) for t in texts])
    # One text may be longer than a chunk: its places then wrap, which only matters for equal hashes.
    order = (h >> _PLACE << _PLACE) | (place & np.uint64((1 << 24) - 1))
    levels = range_minima(order, width)
    low = window_minima(levels, width)
    start = np.arange(len(low))
    inside = start + span <= ends[np.searchsorted(ends, start, side="right")]
    base = start[inside].astype(np.uint64)
    at = base + ((low[inside] - base) & np.uint64((1 << 24) - 1))
    at = np.unique(at).astype(np.int64)
    doc = np.searchsorted(ends, at, side="right")
    pos = at - np.r_[0, ends[:-1]][doc]
    left = tree_reach(levels, at, np.minimum(pos, width - 1), -1)
    right = tree_reach(levels, at, np.minimum(ends[doc] - gram - at, width - 1), 1)
    return np.array(reps, dtype=np.int64)[doc], pos, left.astype(np.int32), right.astype(np.int32), h[at].view(np.int64)


_WINDOW = "rep bigint, pos bigint, left int, right int, key bigint"


def windows(batches: Iterator[pa.RecordBatch], span: int, gram: int) -> Iterator[pa.RecordBatch]:
    """Compact windows of texts (rep, text) of at least ``span`` characters.

    pos: place of the smallest token, key: its hash, left and right: how far the window reaches.
    """
    for batch in batches:
        reps, texts = batch.column("rep").to_pylist(), batch.column("text").to_pylist()
        first, chars = 0, 0
        for k, t in enumerate(texts):
            chars += len(t)
            if chars >= CHUNK or k == len(texts) - 1:
                cols = _chunk_windows(reps[first : k + 1], texts[first : k + 1], span, gram)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], names=["rep", "pos", "left", "right", "key"])
                first, chars = k + 1, 0


def classes(texts: DataFrame, span: int) -> tuple[DataFrame, DataFrame]:
    """From (id, text): (reps: rep, text), (members: rep, id) of texts of at least ``span`` characters."""
    base = texts.where(F.col("id").isNotNull() & (F.length("text") >= span))
    base = base.select("id", F.sha2("text", 256).alias("fp"), "text")
    sizes = base.groupBy("fp").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n"))
    members = skew_join(base.select("fp", "id"), sizes, "fp", "n", "id").select("rep", "id")
    own = sizes.select("rep")
    return base.join(own, base["id"] == own["rep"]).select("rep", "text").dropDuplicates(["rep"]), members


def forms(reps: DataFrame, span: int, gram: int) -> tuple[DataFrame, DataFrame]:
    """(forms: form, key, l, r, many), (holders: form, rep, pos) of windows whose token two texts hold.

    l holds the window's characters before the centre, r those behind its token.
    """
    w = cut(reps.mapInArrow(lambda it: windows(it, span, gram), _WINDOW))
    shared = w.groupBy("key").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi"), F.count(F.lit(1)).alias("k"))
    live = skew_join(w, shared.where("lo < hi").select("key", "k"), "key", "k", "rep")
    part = lambda a, n: F.substring(F.col("text"), (a + 1).cast("int"), n.cast("int"))
    rich = live.join(reps, "rep").select(
        "rep", "pos", "key", part(F.col("pos") - F.col("left"), F.col("left")).alias("l"), part(F.col("pos") + gram, F.col("right")).alias("r")
    )
    rich = cut(rich.withColumn("form", F.xxhash64("key", "l", "r")))
    kinds = rich.groupBy("form", "key", "l", "r").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi"))
    return kinds.select("form", "key", "l", "r", (F.col("lo") < F.col("hi")).alias("many")), rich.select("form", "rep", "pos")


def _common(a: Column, b: Column, most: int, tail: bool) -> Column:
    """Length of the common suffix or prefix."""
    part = (lambda x, k: F.right(x, k)) if tail else (lambda x, k: F.left(x, k))
    fits = lambda k: (F.length(a) >= k) & (F.length(b) >= k) & (part(a, k) == part(b, k))
    # Binary search: agreement of k characters implies that of fewer.
    steps = [1 << k for k in reversed(range(most.bit_length()))]
    grow = lambda lo, step: F.when(fits(lo + step), lo + step).otherwise(lo)
    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), grow)


def form_links(kinds: DataFrame, span: int, gram: int) -> DataFrame:
    """(fa, fb, left, right): forms with a common span, and the characters they share at each side."""
    side = span - gram
    count = kinds.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    known = cut(skew_join(kinds, count.withColumn("k", F.col("n")), "key", "k", "form"))
    full = known.where(F.col("many") & (F.length("l") + F.length("r") >= side))
    same = full.select(F.col("form").alias("fa"), F.col("form").alias("fb"), F.length("l").alias("left"), F.length("r").alias("right"))
    # The interval join: a span must fit between the nearer ends of two windows.
    known = known.withColumn("nl", F.length("l")).withColumn("nr", F.length("r"))
    wide = F.least("a_nl", "b_nl") + F.least("a_nr", "b_nr") >= side
    cold = meet(known.where((F.col("n") > 1) & (F.col("n") <= HOT)), "key", "n", "form", ["l", "r", "nl", "nr"], wide)
    # Hot tokens: one row per exact span through the centre; its classes hold true pairs only.
    hot = known.where(F.col("n") > HOT)
    ends = F.filter(F.sequence(F.lit(0), F.lit(side)), lambda i: (i <= F.length("l")) & (F.lit(side) - i <= F.length("r")))
    cuts = hot.select("form", "key", "l", "r", F.explode(ends).alias("i"))
    cuts = cuts.withColumn("cut", F.xxhash64("key", "i", F.right(F.col("l"), F.col("i")), F.left(F.col("r"), F.lit(side) - F.col("i"))))
    sizes = cuts.groupBy("cut").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    exact = meet(skew_join(cuts, sizes.withColumn("k", F.col("n")), "cut", "k", "form"), "cut", "n", "form", ["l", "r"])
    cols = ["a_form", "b_form", "a_l", "b_l", "a_r", "b_r"]
    both = cold.select(*cols).unionByName(exact.select(*cols).dropDuplicates(["a_form", "b_form"]))
    left = both.withColumn("left", _common(F.col("a_l"), F.col("b_l"), side, True))
    found = left.withColumn("right", _common(F.col("a_r"), F.col("b_r"), side, False)).where(F.col("left") + F.col("right") >= side)
    return same.unionByName(found.select(F.col("a_form").alias("fa"), F.col("b_form").alias("fb"), "left", "right"))


def _rep_pairs(links: DataFrame, holders: DataFrame) -> DataFrame:
    h = cut(holders.select(F.col("form").alias("rep"), F.col("rep").alias("id")).distinct())
    own = links.where("fa = fb").select(F.col("fa").alias("rep")).distinct()
    same = within(h.join(own, "rep", "left_semi"))
    others = across(links.where("fa <> fb").select(F.col("fa").alias("a"), F.col("fb").alias("b")), h).where("x <> y")
    return same.unionByName(others.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))).distinct()


def shared_span_pairs(texts: DataFrame, span: int = 150, gram: int | None = None) -> DataFrame:
    """(a, b), a < b, of all records (id, text) with an identical run of ``span`` characters, 1 or more.

    Null ids and texts and shorter texts are never a case; texts are taken whole; a record
    delivered twice counts once; an empty table gives no rows. Characters are code points.
    """
    gram = span_gram(span, gram)
    reps, members = classes(texts, span)
    kinds, holders = forms(cut(reps), span, gram)
    return expand(_rep_pairs(cut(form_links(kinds, span, gram)), holders), members)


def _joined(runs: DataFrame, by: list[str]) -> DataFrame:
    """Runs (s, e) of each ``by`` with the number of their island; overlapping or touching runs are one."""
    w = Window.partitionBy(*by).orderBy("s", "e")
    before = F.max("e").over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = runs.withColumn("new", (before.isNull() | (before < F.col("s"))).cast("int"))
    return new.withColumn("island", F.sum("new").over(w)).drop("new")


def _ends(kinds: DataFrame, span: int, gram: int) -> DataFrame:
    """(form, other, left, right): the links of forms from both of their ends."""
    links = cut(form_links(kinds, span, gram))
    ends = links.select(F.col("fa").alias("form"), F.col("fb").alias("other"), "left", "right")
    return ends.unionByName(links.where("fa <> fb").select(F.col("fb").alias("form"), F.col("fa").alias("other"), "left", "right"))


def _parts(reps: DataFrame, members: DataFrame, holders: DataFrame, ends: DataFrame, gram: int) -> DataFrame:
    """(rep, form, pos, s, e, island): the shared runs of each class, by passages.

    Whole texts with copies are a run without form.
    """
    # The longest reach of a form to each side covers every run through it.
    reach = ends.groupBy("form").agg(F.max("left").alias("left"), F.max("right").alias("right"))
    part = holders.join(reach, "form").select(
        "rep", "form", "pos", (F.col("pos") - F.col("left")).alias("s"), (F.col("pos") + gram + F.col("right")).alias("e")
    )
    none = F.lit(None).cast("bigint")
    copied = members.distinct().groupBy("rep").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")
    whole = copied.join(reps, "rep").select(
        "rep", none.alias("form"), none.alias("pos"), F.lit(0).cast("bigint").alias("s"), F.length("text").cast("bigint").alias("e")
    )
    return _joined(part.unionByName(whole), ["rep"])


def _spans(parts: DataFrame) -> DataFrame:
    return parts.groupBy("rep", "island").agg(F.min("s").alias("s"), F.max("e").alias("e"))


def passage_holders(texts: DataFrame, span: int = 150, gram: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(passages, holders, members): shared passages and the other records that hold a part of them.

    passages: (rep, start, length, n_records, passage) of each class of equal texts;
    overlapping shared runs are one passage, ``n_records`` counts all records, these included,
    that hold a run of ``span`` characters of it or more; ``passage`` is a digest of its
    characters. holders: (rep, start, other, held_start, held_length), a row for each stretch
    of the passage at ``start`` that another class holds in such runs. members: (rep, id).
    """
    gram = span_gram(span, gram)
    reps, members = classes(texts, span)
    reps, members = cut(reps), cut(members.distinct())
    kinds, forms_of = forms(reps, span, gram)
    ends = _ends(kinds, span, gram)
    parts = cut(_parts(reps, members, forms_of, ends, gram))
    spans = _spans(parts)
    own = forms_of.select(F.col("form").alias("other"), F.col("rep").alias("holder")).distinct()
    runs = parts.where("form is not null").select("rep", "island", "form", "pos").join(ends, "form").join(own, "other").where("rep <> holder")
    runs = runs.select(
        "rep", F.col("island").alias("passage"), "holder", (F.col("pos") - F.col("left")).alias("s"), (F.col("pos") + gram + F.col("right")).alias("e")
    ).distinct()
    held = cut(_joined(runs, ["rep", "passage", "holder"]).groupBy("rep", "passage", "holder", "island").agg(F.min("s").alias("hs"), F.max("e").alias("he")))
    copies = members.groupBy("rep").agg(F.count(F.lit(1)).alias("copies"))
    others = held.select("rep", F.col("passage").alias("island"), "holder").distinct()
    others = others.join(copies.withColumnRenamed("rep", "holder"), "holder").groupBy("rep", "island").agg(F.sum("copies").alias("others"))
    text = F.substring(F.col("text"), (F.col("s") + 1).cast("int"), (F.col("e") - F.col("s")).cast("int"))
    passages = spans.join(others, ["rep", "island"], "left").join(copies, "rep").join(reps, "rep").select(
        "rep",
        F.col("s").alias("start"),
        (F.col("e") - F.col("s")).alias("length"),
        (F.col("copies") + F.coalesce("others", F.lit(0))).alias("n_records"),
        F.sha2(text, 256).alias("passage"),
    )
    holders = held.withColumnRenamed("passage", "island_").join(spans.withColumnRenamed("island", "island_"), ["rep", "island_"]).select(
        "rep", F.col("s").alias("start"), F.col("holder").alias("other"), F.col("hs").alias("held_start"), (F.col("he") - F.col("hs")).alias("held_length")
    )
    return passages, holders, members


def shared_passages(texts: DataFrame, span: int = 150, gram: int | None = None) -> DataFrame:
    """(id, rep, start, length, n_records, passage): passage_holders' passages of each record; rep is its class."""
    passages, _, members = passage_holders(texts, span, gram)
    return passages.join(members, "rep").select("id", "rep", "start", "length", "n_records", "passage")


def shared_part(texts: DataFrame, span: int = 150, gram: int | None = None) -> DataFrame:
    """(id, n_passages, shared_chars, chars, shared_part) of every record with text; 0 where nothing is shared."""
    once = texts.where("id is not null and text is not null").groupBy("id").agg(F.max(F.length("text")).alias("chars"))
    gram = span_gram(span, gram)
    reps, members = classes(texts, span)
    reps = cut(reps)
    kinds, holders = forms(reps, span, gram)
    spans = _spans(_parts(reps, members, holders, _ends(kinds, span, gram), gram))
    sums = spans.groupBy("rep").agg(F.count(F.lit(1)).alias("n_passages"), F.sum(F.col("e") - F.col("s")).alias("shared_chars"))
    sums = sums.join(members.distinct(), "rep").drop("rep")
    out = once.join(sums, "id", "left").na.fill(0, ["n_passages", "shared_chars"])
    part = F.when(F.col("chars") > 0, F.col("shared_chars") / F.col("chars")).otherwise(F.lit(0.0))
    return out.select("id", "n_passages", "shared_chars", "chars", part.alias("shared_part"))
