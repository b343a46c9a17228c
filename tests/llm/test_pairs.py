"""Pair operators against brute force, with odd rows."""

from __future__ import annotations

import random
import re
from itertools import combinations

import numpy as np
import pytest

from inkmesh.llm import common, format_dupes, near_dupes, set_join, shared_spans


def pairs(df):
    rows = [tuple(r) for r in df.collect()]
    assert len(rows) == len(set(rows)), "a pair comes once"
    return set(rows)


def texts(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "id bigint, text string, rep string, key int")


def test_shared_spans_against_brute_force(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij é😀") for _ in range(rng.randint(3, 9)))
    base = [" ".join(word() for _ in range(60)) for _ in range(6)]
    rows = []
    for i in range(40):
        a, b = rng.choice(base), rng.choice(base)
        k = rng.randint(20, 70)
        p = rng.randint(0, len(a) - k)
        rows.append((i, " ".join(word() for _ in range(rng.randint(0, 8))) + a[p : p + k] + word() + b[: rng.randint(0, 60)]))
    rows += [(100, None), (101, ""), (102, "x" * 400), (103, "x" * 300), (104, rows[3][1]), (104, rows[3][1]), (None, base[0]), (105, "ab" * 200)]
    span = 40
    grams = {}
    for i, t in rows:
        if i is not None and t:
            for p in range(len(t) - span + 1):
                grams.setdefault(t[p : p + span], set()).add(i)
    want = {tuple(sorted(x)) for s in grams.values() for x in combinations(s, 2)}
    df = texts(spark, rows)
    assert pairs(shared_spans.shared_span_pairs(df, span, 24)) == want
    covered = {}
    for i, t in rows:
        if i is not None and t is not None:
            mask = np.zeros(len(t), bool)
            for p in range(len(t) - span + 1):
                if len(grams[t[p : p + span]]) > 1:
                    mask[p : p + span] = True
            covered[i] = int(mask.sum())
    got = {r["id"]: r["shared_chars"] for r in shared_spans.shared_part(df, span, 24).collect()}
    assert got == covered


def test_shared_spans_of_hot_token(spark, monkeypatch):
    monkeypatch.setattr(shared_spans, "HOT", 1)
    common = "the common words that all of them hold, "
    rows = [(i, f"{i * 7919:09d} {common}{'tail one and more' if i % 2 else 'other end to it'} {i * 104729:09d}") for i in range(12)]
    span = len(common) + 12
    want = {(a, b) for (a, x), (b, y) in combinations(rows, 2) if any(x[p : p + span] in y for p in range(len(x) - span + 1))}
    assert want and pairs(shared_spans.shared_span_pairs(texts(spark, rows), span, 30)) == want


def test_shared_spans_of_any_length(spark):
    rng = random.Random(4)
    text = lambda n: "".join(rng.choice("abcdefghijklmnopqrs ") for _ in range(n))
    p = text(80)
    df = texts(spark, [(1, text(30) + p + text(9)), (2, text(5) + p), (3, "x" + p[10:71]), (4, text(50))])
    assert pairs(shared_spans.shared_span_pairs(df, 60)) == {(1, 2), (1, 3), (2, 3)}
    assert pairs(shared_spans.shared_span_pairs(df, 62)) == {(1, 2)}
    for span, gram in ((0, None), (-5, None), (10, 11), (10, 0)):
        with pytest.raises(ValueError, match="span"):
            shared_spans.shared_span_pairs(df, span, gram)


def test_windows_are_nodes_of_the_cartesian_tree():
    rng = np.random.default_rng(3)
    for n, width in ((1, 1), (7, 3), (60, 9), (200, 16), (5, 9)):
        order = rng.permutation(n).astype(np.uint64)
        levels = shared_spans.range_minima(order, width)
        at = np.arange(n)
        left = shared_spans.tree_reach(levels, at, np.minimum(at, width - 1), -1)
        right = shared_spans.tree_reach(levels, at, np.minimum(n - 1 - at, width - 1), 1)
        for c in range(n):
            lo = hi = c
            while lo and order[lo - 1] > order[c] and c - lo < width - 1:
                lo -= 1
            while hi < n - 1 and order[hi + 1] > order[c] and hi - c < width - 1:
                hi += 1
            assert (c - left[c], c + right[c]) == (lo, hi)
        low = shared_spans.window_minima(levels, width)
        assert low.tolist() == [order[i : i + width].min() for i in range(n - width + 1)]


def test_holders_of_large_forms(spark, monkeypatch):
    monkeypatch.setattr(common, "BLOCK", 3)
    rng = random.Random(6)
    text = lambda n: "".join(rng.choice("abcdefghijklmnopqrs ") for _ in range(n))
    p, q = text(30), text(30)
    rows = [(i, f"{text(9)}{p}{q if i % 2 else text(12)}{text(9)}") for i in range(16)]
    assert pairs(shared_spans.shared_span_pairs(texts(spark, rows), 30)) == set(combinations(range(16), 2))
    assert pairs(shared_spans.shared_span_pairs(texts(spark, rows), 60)) == {x for x in combinations(range(16), 2) if x[0] % 2 and x[1] % 2}


def test_holders_of_a_passage(spark):
    rng = random.Random(8)
    text = lambda n: "".join(rng.choice("abcdefghijklmnop ") for _ in range(n))
    p, q = text(50), text(60)
    rows = [(1, f"A{p}{q}A"), (2, f"BB{p}B"), (4, f"{p}{q}D"), (5, f"{p}{q}D"), (6, text(90))]
    passages, holders, members = shared_spans.passage_holders(texts(spark, rows), 40, 24)
    got = {(r["rep"], r["start"], r["length"], r["n_records"]) for r in passages.collect()}
    assert got == {(1, 1, 110, 4), (2, 2, 50, 4), (4, 0, 111, 4)}
    held = {(r["rep"], r["start"], r["other"], r["held_start"], r["held_length"]) for r in holders.collect()}
    assert held == {(1, 1, 2, 1, 50), (1, 1, 4, 1, 110), (2, 2, 1, 2, 50), (2, 2, 4, 2, 50), (4, 0, 1, 0, 110), (4, 0, 2, 0, 50)}
    assert {tuple(r) for r in members.collect()} == {(1, 1), (2, 2), (4, 4), (4, 5), (6, 6)}


def test_copies_of_a_large_class_meet_once(spark):
    members = spark.range(1200).selectExpr("0L as rep", "id")
    found = common.expand(spark.createDataFrame([], "a bigint, b bigint"), members)
    assert found.count() == found.distinct().count() == 1200 * 1199 // 2


def test_empty_tables(spark):
    none = texts(spark, [])
    assert pairs(shared_spans.shared_span_pairs(none)) == set()
    assert pairs(near_dupes.near_duplicate_pairs(none)) == set()
    assert near_dupes.near_duplicate_groups(none).count() == 0
    sets = spark.createDataFrame([], "set_id bigint, neighbors array<string>")
    assert pairs(set_join.similar_pairs(sets)) == set()
    rows = spark.createDataFrame([], "row_id bigint, sha256 string, paths array<string>, count bigint")
    assert format_dupes.copies(rows).count() == format_dupes.collapse(rows).count() == 0


def shingle_set(t, width):
    w = re.findall(r"[^\W_]+", t.lower())
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}


def near_rows():
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(400)]
    shared = [rng.choice(vocabulary) for _ in range(30)]
    rows = []
    for k in range(50):
        own = [rng.choice(vocabulary) for _ in range(rng.randint(1, 120))] + (shared if k % 3 else [])
        rows.append(own)
        for _ in range(rng.randint(0, 2)):
            edit = list(own)
            for _ in range(rng.randint(0, max(1, len(own) // 9))):
                edit[rng.randrange(len(edit))] = rng.choice(vocabulary)
            rows.append(edit)
    out = [(i, " ".join(w) + ("." if i % 2 else " !")) for i, w in enumerate(rows)]
    return [*out, (900, None), (901, ""), (902, "one two"), (903, out[4][1].upper()), (903, out[4][1].upper()), (None, out[4][1])]


@pytest.mark.parametrize("hot", [2, 64])
@pytest.mark.parametrize(("tau", "width"), [(0.7, 3), (0.8, 5)])
def test_near_duplicates_against_brute_force(spark, monkeypatch, hot, tau, width):
    monkeypatch.setattr(near_dupes, "HOT", hot)
    rows = near_rows()
    sets = {i: shingle_set(t, width) for i, t in rows if i is not None and t is not None}
    sets = {i: s for i, s in sets.items() if s}
    want = {(a, b) for a, b in combinations(sorted(sets), 2) if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= tau}
    assert want and pairs(near_dupes.near_duplicate_pairs(texts(spark, rows), tau, width)) == want


def test_near_duplicate_groups_are_components(spark):
    df = texts(spark, near_rows())
    links = pairs(near_dupes.near_duplicate_pairs(df))
    group = {r["id"]: r["group_id"] for r in near_dupes.near_duplicate_groups(df).collect()}
    assert all(group[a] == group[b] for a, b in links)
    label = {i: i for i in group}
    for _ in range(len(label)):
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    assert group == label


def test_level_plan_covers_every_pair():
    for tau in (0.5, 0.7, 0.8, 0.9):
        for a in range(1, 400):
            assert near_dupes.level_of(int(a / tau + 1e-9), tau) <= near_dupes.level_of(a, tau) + 1
            top, blocks = near_dupes.level_plan(near_dupes.level_of(a, tau), tau)
            assert a <= top and blocks > (a + int(a / tau + 1e-9)) * (1 - tau) / (1 + tau)


def set_rows():
    rng = random.Random(3)
    rows, hubs = [], ["hub0", "hub1", "hub2"]
    for k in range(120):
        own = [f"t{rng.randint(0, 900)}" for _ in range(rng.randint(1, 25))] + [h for h in hubs if rng.random() < 0.7]
        rows.append(own)
        if k % 2:
            rows.append([x for x in own if rng.random() < 0.8] + ["more", None])
    rows += [["hub0"], ["hub0", "hub1"], ["hub1", "hub0", "hub0"], [], [None], None, ["Hub0"]]
    rows += [["hub0", "hub1", f"u{i}"] for i in range(60)]  # similar by two common tokens alone
    return [*enumerate(rows), (0, rows[0])]


@pytest.mark.parametrize("leaf", [4, 48])
def test_set_join_against_brute_force(spark, leaf):
    rows = set_rows()
    df = spark.createDataFrame([(i, v, 0, "m") for i, v in rows], "set_id bigint, neighbors array<string>, rep int, id string")
    sets = {i: {x for x in v if x is not None} for i, v in rows if v}
    sets = {i: s for i, s in sets.items() if s}
    want = {(a, b) for a, b in combinations(sorted(sets), 2) if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.5}
    got = pairs(set_join.similar_pairs(df, 0.5, leaf=leaf))
    assert not got - want
    assert len(want - got) <= 0.001 * len(want)


def test_format_duplicates(spark):
    sha = "ab" * 32
    rows = [
        (5, sha, ["a/b.md", "c.md"], 2),
        (3, f" {sha.upper()}\n", ["C.md", "./A\\b.md"], 2),
        (3, f" {sha.upper()}\n", ["C.md", "./A\\b.md"], 2),
        (9, sha, ["a/b.md", "c.md", "c.md"], 2),
        (7, sha, ["c.md", "c.md", "a/b.md"], 2),
        (11, sha, ["a/b.md", "c.md"], None),
        (12, sha, ["c.md", "a/b.md"], None),
        (13, None, ["a"], 1),
        (14, None, ["a"], 1),
        (15, sha, None, 1),
        (16, sha, [], 0),
        (17, sha, [], 0),
        (18, sha, [None, "a"], 1),
        (19, sha, ["A", None], 1),
        (20, sha, ["null", "a"], 1),
    ]
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], "row_id bigint, sha256 string, paths array<string>, count bigint, first_id int, copies string")
    assert pairs(format_dupes.copy_pairs(df)) == {(3, 5), (7, 9), (11, 12), (16, 17), (18, 19)}
    kept = {r["row_id"]: r["copies"] for r in format_dupes.collapse(df).collect()}
    assert kept == {3: 2, 7: 2, 11: 2, 13: 1, 14: 1, 15: 1, 16: 2, 18: 2, 20: 1}
