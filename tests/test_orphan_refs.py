"""Dangling references, with odd rows."""

from __future__ import annotations

from datetime import datetime, timedelta

from inkmesh.operators import orphan_refs
from inkmesh.operators.orphan_refs import BUCKET_BITS

T0 = datetime(2024, 1, 1)
DAY = timedelta(days=1)
FILES = "file_id bigint, path string, added_at timestamp_ntz, deleted_at timestamp_ntz"
NOTES = "note_id bigint, path string, created_at timestamp_ntz, deleted_at timestamp_ntz, kind string, key string"
LINKS = "link_id bigint, src string, kind string, raw string, status string, candidates array<string>, seen_at timestamp_ntz, slot int, start bigint"


def run(spark, links, notes, files=()):
    n = spark.createDataFrame([(i, p, a, b, "k", "x") for i, (p, a, b) in enumerate(notes)], NOTES)
    f = spark.createDataFrame([(i, p, a, b) for i, (p, a, b) in enumerate(files)], FILES)
    rows = spark.createDataFrame([(i, s, k, r, "resolved", c, at, 9, 9) for i, s, k, r, c, at in links], LINKS)
    return {(r["link_id"], r["slot"]) for r in orphan_refs.dangling_links(rows, n, f).collect()}, orphan_refs.dangling_report(rows, n, f)


def test_lifetimes_and_spellings(spark):
    notes = [("a/b.md", T0, T0 + 10 * DAY), ("a/b.md", T0 + 10 * DAY, T0 + 20 * DAY), ("a/b.md", T0 + 30 * DAY, None), ("x y/é.md", T0, None), ("null.md", None, None)]
    files = [("img/p.png", T0 + 5 * DAY, None), ("README.md", T0, T0)]
    at = lambda d: T0 + d * DAY
    links = [
        (1, "a/c.md", "wikilink", "b|alias", None, at(1)),
        (2, "a/c.md", "wikilink", "b\\|alias", None, at(19)),
        (3, "a/c.md", "wikilink", "b", None, at(20)),  # just deleted
        (4, "a/c.md", "wikilink", "b", None, at(30)),
        (5, "a/c.md", "markdown", "./b.md#h", None, at(9.999)),
        (6, "a/c.md", "markdown", '<../x%20y/é.md> "T"', None, at(1)),
        (7, "a/c.md", "markdown", "b", None, at(1)),  # beside the source, suffix added
        (8, "q/c.md", "markdown", "b", None, at(1)),  # names count for wikilinks only
        (9, "q/c.md", "wikilink", "B", None, at(1)),
        (10, None, "wikilink", " !/a//./b.md ", None, at(1)),
        (11, "q/c.md", "wikilink", "http://x", None, at(1)),
        (12, "q/c.md", "wikilink", "#top", None, at(1)),
        (13, "q/c.md", "wikilink", "  ", None, at(1)),
        (14, "q/c.md", "wikilink", None, [None, "img/p.png", "a/b", "gone"], at(6)),
        (15, "q/c.md", "markdown", "p.png", ["img/p.png"], at(1)),
        (16, "q/c.md", "wikilink", "README", None, at(1)),
        (17, "q/c.md", "wikilink", "null", None, at(1)),
        (3, "a/c.md", "wikilink", "b", None, at(20)),
        (18, "q/c.md", None, "a/b", [], at(1)),
        (19, "q/c.md", "wikilink", "b", ["gone"], None),
        (20, "a/c.md", "markdown", "/b.md", None, at(1)),  # from the root only
        (21, "q/c.md", "markdown", "/a/b.md#x", None, at(1)),
        (22, "q/c.md", "wikilink", "a/b", None, at(1)),  # two unequal rows of one id
        (22, "q/c.md", "wikilink", "a/gone", None, at(1)),
    ]
    got, report = run(spark, links, notes, files)
    assert got == {(3, 0), (8, 0), (9, 0), (14, 3), (14, 4), (15, 0), (15, 1), (16, 0), (17, 0), (20, 0), (22, 0)}
    assert sum(r["dangling"] for r in report.collect()) == len(got)
    by = {(r["referenced"], r["month"]): r["dangling"] for r in report.collect()}
    assert by[("shared_files", "2024-01")] == 2 and by[("none", "2024-01")] == 8 and by[("notes", "2024-01")] == 1


def test_runs_over_many_buckets(spark):
    step = timedelta(microseconds=1 << BUCKET_BITS)
    notes = [("a.md", T0 + k * step / 3, T0 + (k + 1) * step / 3 - (k % 5 == 4) * DAY) for k in range(30)]
    links = [(i, "s.md", "wikilink", "a", None, T0 + i * 5 * DAY) for i in range(220)]
    got, _ = run(spark, links, notes)
    assert got == {(i, 0) for i, *_, t in links if not any(a <= t < b for _, a, b in notes)}


def test_name_of_many_parents(spark):
    """A name that very many parents share, with lifetimes that overlap, touch, nest and leave gaps."""
    notes = [(f"d{k}/README.md", T0 + k * DAY / 7, T0 + k * DAY / 7 + (k % 11) * DAY / 20) for k in range(1500)]
    links = [(i, "s.md", "wikilink", "README", None, T0 + i * DAY / 3) for i in range(660)]
    got, _ = run(spark, links, notes)
    assert got == {(i, 0) for i, *_, t in links if not any(a <= t < b for _, a, b in notes)}
    assert 0 < len(got) < 660


def test_empty_tables(spark):
    links = [(1, "s.md", "wikilink", "a", None, T0)]
    assert run(spark, links, [])[0] == {(1, 0)}
    assert run(spark, [], [("a.md", T0, None)])[0] == set()
    assert run(spark, [], [])[0] == set()
