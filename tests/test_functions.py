"""Expressions against Python's own functions."""

from __future__ import annotations

import posixpath
import urllib.parse
from pathlib import PurePosixPath

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from inkmesh.functions import color, markdown, paths, text

few = settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))


def column(spark, values, f):
    df = spark.createDataFrame(list(enumerate(values)), "i int, x string")
    return [r["y"] for r in df.select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


parts = st.lists(st.sampled_from(["a", "b.md", "..", ".", "", "c d", "é"]), min_size=1, max_size=7)


@few
@given(st.lists(parts, min_size=1, max_size=60))
def test_normpath(spark, many):
    values = ["/".join(p).lstrip("/") for p in many]
    assert column(spark, values, paths.normpath) == [posixpath.normpath(v) for v in values]


@few
@given(st.lists(st.text("ab%2+C3A9 é", max_size=12), min_size=1, max_size=60))
def test_percent_decode(spark, values):
    assert column(spark, values, text.percent_decode) == [urllib.parse.unquote(v) for v in values]


@few
@given(st.lists(st.text("a\n\r\x0b\x85  ", max_size=8), min_size=1, max_size=60))
def test_split_lines(spark, values):
    assert column(spark, values, text.split_lines) == [v.splitlines() if v else [] for v in values]


def test_path_parts(spark):
    values = ["a/b/c.md", "c.tar.gz", ".hidden", "a/.x", "foo.v2", "a", ""]
    assert column(spark, values, paths.stem) == [PurePosixPath(v).stem for v in values]
    assert column(spark, values, paths.parent) == [posixpath.dirname(v) for v in values]
    assert column(spark, ["b/x.md", "x.md"], lambda c: paths.join_path(paths.parent(c), F.lit("../y"))) == ["y", "../y"]


def test_strip_code(spark):
    t = "a `x [[b]]` c\n```py\n[[d]]\n~~~\n[[e]]\n  ```\n[[f]]\n"
    out = column(spark, [t], markdown.strip_code)[0]
    assert out.count("\n") == t.count("\n") and "[[e]]" in out
    assert not any(x in out for x in ("[[b]]", "[[d]]", "[[f]]", "```"))


def test_targets(spark):
    md = ["[a](b.md)", "![i](x.png)", "[a](<b c.md>)", "[a](b%20c.md#h \"T\")", "no"]
    assert column(spark, md, markdown.md_targets) == [["b.md"], [], ["b c.md"], ['b%20c.md#h "T"'], []]
    assert column(spark, ['b%20c.md#h "T"', "b c.md", " <x y> ", "#h", ""], markdown.clean_target) == ["b%20c.md#h \"T\"".split("#")[0].replace("%20", " "), "b c.md", "x y", "", ""]
    assert column(spark, ["a|b|c", " !a.md#h", "x\\|y|z"], markdown.graph_target) == ["a", "a.md", "x\\"]
    assert column(spark, ["a|b|c", " !a.md#h", "x\\|y|z"], markdown.scan_target) == ["a", "a.md#h", "x|y"]


@pytest.mark.parametrize(("fragment", "there"), [("My Head", True), ("my-head", True), ("Été & co", True), ("^abc", True), ("^ab", False), ("Other", False)])
def test_fragments(spark, fragment, there):
    t = "# My Head\n\ntext ^abc\n\n## Été & co  \n"
    assert column(spark, [t], lambda c: markdown.has_fragment(c, F.lit(fragment))) == [there]


def test_frontmatter_body(spark):
    values = ["---\na: 1\n---\nx", "---\n---\nx", "---\na: 1\nx", "x\n---\n", ""]
    assert column(spark, values, text.body) == ["x", "---\n---\nx", "---\na: 1\nx", "x\n---\n", ""]
    assert column(spark, ["---\na: 1\n---\nx  \r\n y\t\n\n"], text.normal_content) == ["x\n y"]


def test_contrast(spark):
    assert column(spark, ["#ffffff", "#000000", "#777777"], lambda c: color.contrast(c, F.lit("#FFFFFF"))) == [1.0, 21.0, 4.48]
    rows = color.contrast_checks(spark, color.palette(), 2.0).collect()
    assert len(rows) == 8 and all(r["ok"] == (r["ratio"] >= 2.0) for r in rows)
    for bad in (True, 0.5, float("nan"), "2"):
        with pytest.raises(ValueError):
            color.contrast_checks(spark, color.palette(), bad)
    with pytest.raises(ValueError, match="unknown"):
        color.check_colors({"pink": "#ffffff"})
    with pytest.raises(ValueError, match="#RRGGBB"):
        color.check_colors({"dark_node": "red"})
    assert "#7aa2f7" in color.render_css(color.palette())
