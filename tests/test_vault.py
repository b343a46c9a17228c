"""Resolvers, scan, duplicates, groups and verification on small vaults."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from inkmesh.operators import dupes, groups, links, redirects
from inkmesh.sources import vault as vaults

NOTES = {
    "a/note.md": "# Note\n\nSee [[b/other]] and [[index|Start]] and [[missing]] and [[note]].\n",
    "b/note.md": "---\ntags: [x, '#y']\ntype: howto\nstatus: 1\n---\n[[../a/note]] [[other.md#Head]] ![[other#Nope]] [[readme]]\n",
    "b/other.md": "---\ntag: solo\n---\n# Head\n\ntext ^blk\n```\n[[in-code]]\n```\n",
    "index.md": "[ok](a/note.md) [dir](b/) [web](http://x.y) [no](gone.md) [ph](url) [site](/blog/x) [[index#Top]] [[a\\|b]]\n",
    "c d.md": "",
}


@pytest.fixture(scope="module")
def vault(spark):
    return vaults.from_rows(spark, NOTES, ["img/p.png"]).cache()


def pairs(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_derived_tables(vault):
    assert pairs(vault.dirs, "dir") == [("a",), ("b",), ("img",)]
    assert {(r["stem"], r["winner"], r["n"]) for r in vault.stems.collect()} >= {("note", "b/note.md", 2), ("c d", "c d.md", 1)}


def test_edges(vault):
    assert pairs(links.edges(vault), "src", "dst") == [
        ("a/note.md", "b/note.md"),
        ("a/note.md", "b/other.md"),
        ("a/note.md", "index.md"),
        ("b/note.md", "a/note.md"),
        ("b/note.md", "b/other.md"),
    ]


def test_wanted(vault):
    assert pairs(links.unresolved(vault), "target", "references") == [("a\\", 1), ("in-code", 1), ("missing", 1), ("readme", 1)]
    assert links.unresolved(vault, strict=True).count() == 0


def test_status(spark, vault):
    rows = [("a/note.md", "note"), ("a/note.md", "b/note"), ("index.md", "other#Head"), ("index.md", "nope")]
    df = links.status(spark.createDataFrame(rows, "src string, raw string"), vault)
    assert pairs(df, "raw", "status", "candidates") == [
        ("b/note", "resolved", ["b/note.md"]),
        ("nope", "missing", []),
        ("note", "ambiguous", ["a/note.md", "b/note.md"]),
        ("other#Head", "resolved", ["b/other.md"]),
    ]


def test_scan(vault):
    assert pairs(links.broken_links(vault), "src", "kind", "target") == [
        ("a/note.md", "wikilink", "missing"),
        ("b/note.md", "wikilink", "readme"),
        ("index.md", "markdown", "gone.md"),
    ]
    s = links.scan_summary(vault).first().asDict()
    want = {"scan_files": 5, "tokens": 16, "broken_total": 3, "broken_files": 3, "external_ignored": 1, "placeholder_ignored": 1, "site_path_ignored": 1, "html_doc_ignored": 0, "priority_files": 1}
    assert s == want
    assert links.broken_links(vault, ("a/", "b/")).count() == 1
    assert pairs(links.broken_by_dir(vault), "dir", "broken") == [("a", 1), ("b", 1), ("index.md", 1)]


def test_groups(vault):
    e = links.edges(vault)
    got = dict(pairs(groups.group_sizes(vault, e), "name", "count"))
    assert got == {"path:a": 1, "path:b": 2, "path:.": 2, "tag:x": 1, "tag:y": 1, "tag:solo": 1, "type:howto": 1, "status:1": 1, "health:orphan": 1, "health:broken-link": 4}
    top = groups.suggest(vault, e, limit=2).collect()
    assert [r["name"] for r in top] == ["health:broken-link", "path:."] and top[1]["obsidian_query"] == "path:/" and top[0]["requires_tool"]
    for bad in ({"limit": 0}, {"min_count": 0}, {"theme": "pink"}):
        with pytest.raises(ValueError):
            groups.suggest(vault, e, **bad)


def test_frontmatter_strictness(spark):
    bad = vaults.from_rows(spark, {"a.md": "---\nx: [\n---\n"}).notes
    assert groups.frontmatter(bad).first()["tags"] == []
    with pytest.raises(Exception, match="YAML|yaml|flow"):
        groups.frontmatter(bad, strict=True).collect()


def test_fragments(vault):
    got = pairs(redirects.verify_fragments(vault).where("fragment is not null"), "file", "target", "fragment", "ok")
    assert got == [("b/note.md", "b/other.md", "Head", True), ("b/note.md", "b/other.md", "Nope", False), ("index.md", "index.md", "Top", False)]
    assert pairs(redirects.verify_fragments(vault).where("status = 'ambiguous'"), "file") == [("a/note.md",)]


def test_redirects(spark):
    stub = lambda t: f"# x\n\n> Moved to [[{t}]].\n"
    v = vaults.from_rows(spark, {"a.md": stub("b"), "b.md": stub("c"), "c.md": "end", "d.md": stub("gone"), "e.md": stub("f|F"), "f.md": stub("e#h"), "g.md": stub("e"), "h.md": stub("c")})
    got = {r["source"]: (r["status"], r["final_target"], r["ok"]) for r in redirects.verify_redirects(v).collect()}
    assert got == {
        "a.md": ("chain", "c.md", False),
        "b.md": ("resolved", None, True),
        "d.md": ("missing", None, False),
        "e.md": ("cycle", None, False),
        "f.md": ("cycle", None, False),
        "g.md": ("cycle", None, False),
        "h.md": ("resolved", None, True),
    }


def test_exact_duplicates(spark):
    notes = vaults.from_rows(spark, {"a/b.md": "---\nt: 1\n---\nsame  \n", "a.md": "same\r\n", "z.md": "same", "y.md": "other", "x.md": "other"}).notes
    got = [(r["count"], r["paths"]) for r in dupes.exact_duplicates(notes).collect()]
    assert got == [(3, ["a/b.md", "a.md", "z.md"]), (2, ["x.md", "y.md"])]
    assert [r["paths"] for r in dupes.exact_duplicates(notes, include_frontmatter=True).collect()] == [["x.md", "y.md"]]
    assert len(dupes.exact_duplicates(notes, limit=1).collect()) == 1
    with pytest.raises(ValueError):
        dupes.exact_duplicates(notes, limit=0)


def test_paragraphs(spark):
    p = "A paragraph that is long enough\nover two lines."
    notes = vaults.from_rows(spark, {"a.md": f"# H\n\n{p}\n", "b.md": f"---\nk: v\n---\nintro\n\n{p}\n> quote\n```\n{p}\n```\n{p}\n", "c.md": f"{p} more"}).notes
    r = dupes.paragraph_duplicates(notes, 20).collect()
    assert len(r) == 1 and r[0]["count"] == 3
    assert [(o["path"], o["line"]) for o in r[0]["occurrences"]] == [("a.md", 3), ("b.md", 3), ("b.md", 10)]


def test_review_to_plan(spark, vault):
    v, e = vault.notes.select("path"), links.edges(vault)
    cand = spark.createDataFrame([("a/note.md", "b/note.md", 0.5)], "left string, right string, score double")
    r = dupes.review(cand, vault.notes, v, e)
    row = r.first()
    assert row["shared_neighbors"] == ["b/other.md"] and (row["left_in"], row["left_out"]) == (1, 3) and row["action"] == "review"
    assert dupes.redirect_plan(r).count() == 0
    plan = dupes.redirect_plan(r.withColumn("action", F.lit("redirect")))
    assert [tuple(x) for x in dupes.verify_plan(plan, vault.notes).collect()] == [("a/note.md", "b/note.md", True, [])]
    changed = vault.notes.where("path <> 'b/note.md'").withColumn("text", F.concat("text", F.lit("!")))
    assert dupes.verify_plan(plan, changed).first()["errors"] == ["source changed", "target missing"]
    with pytest.raises(Exception, match="unknown note"):
        dupes.review(spark.createDataFrame([("nope.md", "b/note.md", 1.0)], cand.schema), vault.notes, v, e).collect()
