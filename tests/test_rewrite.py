"""Text transforms, the apply sink, readers and renderers."""

from __future__ import annotations

import json
import subprocess

import pytest

from inkmesh import analyzers, cli, config
from inkmesh.operators import apply, links, rewrite
from inkmesh.sources import records, sinks
from inkmesh.sources import vault as vaults


def notes(spark, d):
    return vaults.from_rows(spark, d).notes


def new(df):
    return {r["path"]: r["new_text"] for r in df.collect()}


def test_migrate_links(spark):
    text = "[[old|A]] [[old#h]] ![[old.md]] [x](old.md#h) ![i](old.md) `[[old]]` [[other]]\n```\n[[old]]\n```\n[[old]]\n"
    mapping = spark.createDataFrame([("old", "dir/new"), ("old.md", "dir/new")], "old string, new string")
    got = new(rewrite.migrate_links(notes(spark, {"a.md": text, "b.md": "[[other]]"}), mapping))
    want = "[[dir/new|A]] [[dir/new#h]] ![[dir/new]] [x](dir/new#h) ![i](old.md) `[[old]]` [[other]]\n```\n[[old]]\n```\n[[dir/new]]\n"
    assert got == {"a.md": want}
    assert new(rewrite.migrate_links(notes(spark, got), mapping)) == {}


def test_alias_text():
    assert rewrite.alias_text("---\nt: 1\n---\nx", "new") == "---\nt: 1\naliases:\n  - new\n---\nx"
    assert rewrite.alias_text("---\naliases: [a]\n---\n", "new") == "---\naliases: [a, new]\n---\n"
    listed = rewrite.alias_text("---\naliases:\n  - a\nz: 1\n---\n", "new")
    assert listed == "---\naliases:\n  - a\n  - new\nz: 1\n---\n" and rewrite.alias_text(listed, "new") == listed
    assert rewrite.alias_text("no head", "new") == "no head"
    with pytest.raises(ValueError):
        rewrite.alias_text("---\naliases: one\n---\n", "new")


def test_fix_pipes(spark):
    text = "|\n||-- x\n|| a | b |\n||text\n||  \n| a | b |\n|--- |\n|loose\nplain\n"
    got = rewrite.fix_pipes(notes(spark, {"a.md": text, "b.md": "| a | b |\n"})).collect()
    assert [(r["path"], r["new_text"], r["changes"]) for r in got] == [("a.md", "\n|-- x\n| a | b |\ntext\n\n| a | b |\n|--- |\nloose\nplain\n", 6)]


def test_sync_counts(spark):
    n = notes(spark, {"README.md": "# V\n12 MD and 13 MD", "index.md": "7MD", "x.md": "1 MD"})
    assert new(rewrite.sync_counts(n, ["README.md", "index.md"], 7)) == {"README.md": "# V\n7 MD and 13 MD"}


def test_convert_links(spark):
    text = "- 2024-01-02 [T](old/a.md) — n\n- 2024-01-03 [U](old/b.md) — n\nplain [T](old/a.md)\n"
    mapping = spark.createDataFrame([("old/a.md", "new/a")], "old string, new string")
    r = rewrite.convert_links(notes(spark, {"i.md": text}), mapping).first()
    assert r["new_text"] == text.replace("[T](old/a.md) —", "[[new/a|T]] —", 1) and (r["converted"], r["missing"]) == (1, 1)


def test_tidy_articles(spark):
    text = "---\ntitle: t\ntags: [x]\ntopic: old\n---\n- 导入来源: y\nbody\n\n\n\nmore\n"
    cov = spark.createDataFrame([("articles/2024/a.md", json.dumps({"topic": "T", "decision": None}))], "key string, entry string")
    n = notes(spark, {"a.md": text, "b.md": "no head"})
    rows = {r["path"]: r for r in rewrite.tidy_articles(n, "2024", cov).collect()}
    out = rows["a.md"]["new_text"]
    assert out == '---\ntitle: t\ntags: [wechat-archive]\nparent: [[index-2024]]\ntopic: "T"\ndecision: null\n---\nbody\n\nmore\n\n[[index-2024|← 返回索引]]\n'
    assert rows["b.md"]["error"] == "missing YAML frontmatter" and rows["b.md"]["new_text"] == "no head"
    assert rewrite.tidy_text(out, "2024", {"topic": "T", "decision": None}) == out


def test_fix_unlinked(spark):
    d = {"20-areas/arch/x.md": "text", "20-areas/arch/a.md": "[[x]]", "20-areas/arch/README.md": "# Arch hub\n", "top.md": "t\n\n## 关联\n"}
    v = vaults.from_rows(spark, d)
    got = new(rewrite.fix_unlinked(v))
    assert got["20-areas/arch/x.md"] == "text\n\n## 关联\n\n- [[20-areas/arch/README|Arch hub]]\n- [[20-areas/README|README]]\n- [[20-areas/arch/a|a]]\n"
    assert got["top.md"] == "t\n\n## 关联\n- [[index|index]]\n- [[README|README]]\n"
    assert set(got) == {"20-areas/arch/x.md", "top.md"}


@pytest.fixture
def repo(tmp_path):
    files = {"a/old.md": "---\nt: 1\n---\nold text\n", "b/new.md": "---\nk: v\n---\nnew text\n", "in.md": "see [[a/old|O]] and [[a/old#x]]\n", "_t.md": "hidden\n"}
    for p, t in files.items():
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text(t)
    for args in (["init", "-q"], ["add", "-A"]):
        subprocess.run(["git", "-C", str(tmp_path), *args], check=True)
    return tmp_path


PLAN = [{"source": "a/old.md", "target": "b/new.md", "preserve_alias": True}]


def texts(root):
    return {str(p.relative_to(root)): p.read_text() for p in root.rglob("*.md") if ".inkmesh" not in str(p)}


def test_apply_verify_rollback(spark, repo):
    before = texts(repo)
    preview = apply.apply_plan(spark, repo, PLAN)
    assert texts(repo) == before and {c["path"] for c in preview["changes"]} == {"a/old.md", "b/new.md", "in.md"}
    with pytest.raises(ValueError, match="confirm"):
        apply.apply_plan(spark, repo, PLAN, write=True)
    report = apply.apply_plan(spark, repo, PLAN, write=True, confirm=True)
    after = texts(repo)
    assert after["in.md"] == "see [[b/new|O]] and [[b/new#x]]\n" and after["a/old.md"].endswith("> Moved to [[b/new]].\n") and "- old" in after["b/new.md"]
    assert all(r["ok"] for r in apply.verify_manifest(repo, report["manifest"]))
    (repo / "in.md").write_text("edited\n")
    rows = apply.rollback(repo, report["manifest"], write=True, confirm=True)
    assert {r["path"]: r["status"] for r in rows} == {"a/old.md": "restored", "b/new.md": "restored", "in.md": "conflict"}
    assert texts(repo) == before | {"in.md": "edited\n"}


def test_apply_trash(spark, repo):
    apply.apply_plan(spark, repo, PLAN, write=True, confirm=True, source_after="trash")
    assert not (repo / "a/old.md").exists() and (repo / ".trash/a/old.md").exists()


@pytest.mark.parametrize("fails_at", [1, 2, 3])
def test_commit_is_all_or_nothing(repo, monkeypatch, fails_at):
    before, calls, real = texts(repo), [], apply.write_atomic

    def write(path, data):
        if ".inkmesh" not in str(path):
            calls.append(path)
            if len(calls) == fails_at:
                raise OSError("disk full")
        real(path, data)

    monkeypatch.setattr(apply, "write_atomic", write)
    with pytest.raises(OSError, match="disk full"):
        apply.commit(repo, {p: "changed" for p in ("a/old.md", "b/new.md", "in.md")}, [], {})
    assert texts(repo) == before


def test_apply_refuses(spark, repo):
    with pytest.raises(ValueError, match="unsafe"):
        apply.safe_path(repo, "../x")
    with pytest.raises(ValueError, match="changed"):
        apply.apply_plan(spark, repo, [{**PLAN[0], "source_sha256": "0" * 64}])
    (repo / "c").mkdir()
    (repo / "c/old.md").write_text("twin\n")
    (repo / "in2.md").write_text("[[old]]\n")
    subprocess.run(["git", "-C", str(repo), "add", "-A"], check=True)
    with pytest.raises(apply.PreflightError) as e:
        apply.apply_plan(spark, repo, PLAN)
    assert [(i["file"], i["status"]) for i in e.value.issues] == [("in2.md", "ambiguous")]


def test_sources(spark, repo):
    assert vaults.tracked_files(repo) == ["_t.md", "a/old.md", "b/new.md", "in.md"]
    (repo / "bad.md").write_bytes(b"a\xffb")
    (repo / ".trash").mkdir()
    (repo / ".trash/x.md").write_text("x")
    assert vaults.notes_on_disk(repo) == ["_t.md", "a/old.md", "b/new.md", "bad.md", "in.md"]
    lossy = {r["path"]: r["text"] for r in vaults.read_texts(spark, repo, ["_t.md", "bad.md", "gone.md"]).collect()}
    assert lossy == {"_t.md": "hidden\n", "bad.md": "ab"}
    with pytest.raises(Exception, match="UTF8|UTF-8"):
        vaults.read_texts(spark, repo, ["bad.md"], strict=True).collect()


def test_records(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"left": "a"},\n {"left": "b"}]')
    (tmp_path / "b.jsonl").write_text('{"left": "a"}\n{"left": "b"}\n')
    for name in ("a.json", "b.jsonl"):
        assert [r["left"] for r in records.read_records(spark, str(tmp_path / name)).orderBy("left").collect()] == ["a", "b"]
    (tmp_path / "m.tsv").write_text("x\ty\tz\n\nx\tw\n")
    assert [tuple(r) for r in records.read_mapping(spark, str(tmp_path / "m.tsv")).collect()] == [("x", "w")]
    (tmp_path / "m.tsv").write_text("no tab\n")
    with pytest.raises(Exception, match="no tab"):
        records.read_mapping(spark, str(tmp_path / "m.tsv")).collect()
    with pytest.raises(ValueError):
        records.parse_records("[1]")


def test_renderers(spark, tmp_path):
    rows = [{"a": 1, "b": ["x,y", "z|"]}, {"a": None, "b": None}]
    assert sinks.csv_text(rows, ["a", "b"]) == 'a,b\n1,"[""x,y"",""z|""]"\n,\n'
    assert sinks.markdown_table([], ["a"]) == "" and "z\\|" in sinks.markdown_table(rows, ["a", "b"])
    assert list(sinks.emit(rows[:1], "jsonl")) == ['{"a":1,"b":["x,y","z|"]}']
    with pytest.raises(ValueError):
        list(sinks.emit([{"a": float("nan")}], "json"))
    df = spark.createDataFrame([(1, ["a", "b"], None)], "n int, l array<string>, s string")
    sinks.write_csv(df.coalesce(1), str(tmp_path / "out"))
    assert "".join(p.read_text() for p in (tmp_path / "out").glob("*.csv")) == 'n,l,s\n1,"[""a"",""b""]",""\n'


@pytest.mark.parametrize(
    ("text", "key"),
    [("x: {}", "x"), ("graph: {theme: pink}", "graph.theme"), ("graph: {min_contrast: true}", "graph.min_contrast"), ("graph: {min_contrast: .inf}", "graph.min_contrast"), ("graph_groups: {limit: 0}", "graph_groups.limit"), ("graph_groups: {limit: 1, limit: 2}", "limit"), ("- a", "mapping"), ("graph: [", "read"), ("graph: {color: x}", "graph.color")],
)
def test_config_errors(tmp_path, text, key):
    (tmp_path / config.FILE).write_text(text)
    with pytest.raises(config.ConfigError, match=key):
        config.load_config(tmp_path)


def test_config_values(tmp_path):
    assert config.load_config(tmp_path) == config.Config()
    with pytest.raises(config.ConfigError, match="no such"):
        config.load_config(tmp_path, tmp_path / "none.yaml")
    (tmp_path / config.FILE).write_text("graph: {theme: nord, min_contrast: 3}\ngraph_groups: {limit: 5}\n")
    assert config.load_config(tmp_path) == config.Config("nord", 3.0, None, None, 5)
    assert [config.pick(*x) for x in ((1, 2, 3), (None, 2, 3), (None, None, 3))] == [1, 2, 3]


class Point:
    def __init__(self, name, f):
        self.name, self.value, self.f = name, f"mod:{name}", f

    def load(self):
        if isinstance(self.f, Exception):
            raise self.f
        return self.f


def test_analyzers(spark):
    v = vaults.from_rows(spark, {"a.md": "[[b]]", "b.md": ""})
    assert analyzers.run("link-stats", v, []) == [{"notes": 2, "linked_notes": 1, "edges": 1}]
    points = [Point("ok", lambda v: {"n": 1}), Point("bad", lambda v: 1 / 0), Point("nan", lambda v: float("nan")), Point("no", 3), Point("lost", ImportError("x"))]
    assert [n for n, _ in analyzers.listed(points)] == ["bad", "link-stats", "lost", "nan", "no", "ok"]
    assert analyzers.run("ok", v, points) == {"n": 1}
    for name, why in (("bad", "failed"), ("nan", "JSON"), ("no", "callable"), ("lost", "loaded"), ("none", "unknown")):
        with pytest.raises(analyzers.AnalyzerError, match=why):
            analyzers.run(name, v, points)
    with pytest.raises(analyzers.AnalyzerError, match="twice"):
        analyzers.listed([Point("x", None), Point("x", None)])


def test_command_line(spark, repo, capsys):
    def call(*args):
        code = cli.main(["--root", str(repo), *args])
        return code, capsys.readouterr().out

    code, out = call("graph", "--format", "jsonl")
    assert code == 0 and json.loads(out.splitlines()[0])["path"] == "a/old.md"
    assert json.loads(call("scan", "--json")[1])[0]["broken_total"] == 0
    assert call("dedupe-verify-fragments", "--format", "json")[1].count('"ok": false') == 1
    assert "| name |" in call("graph-groups", "--format", "md")[1]
    assert call("graph-colors", "--min-contrast", "20")[0] == 1
    assert call("dedupe-exact", "--limit", "0")[0] == 1
    assert call("stats", "--format", "jsonl")[0] == 0


def test_streaming(spark, tmp_path):
    from inkmesh.operators.dupes import exact_duplicates
    from inkmesh.streaming import refresh

    rows = spark.sql(
        "select id as note_id, concat('n', id % 3, '.md') as path, if(id < 3, 'old', 'same') as content, 'x' as sha256, 'o' as origin, "
        "timestamp_ntz'2024-01-01' as created_at, cast(null as timestamp_ntz) as deleted_at, timestamp_ntz'2024-01-01' + make_interval(0,0,0,id) as loaded_at from range(6)"
    )
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(refresh.SCHEMA).parquet(str(tmp_path / "in"))
    q = refresh.run_on_batches(stream, exact_duplicates, str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination(60)
    assert [r["paths"] for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [["n0.md", "n1.md", "n2.md"]]
    q = refresh.link_events(stream).writeStream.outputMode("complete").format("memory").queryName("links_by_day").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("links_by_day").count() == 6


def test_data_source(spark, repo):
    from inkmesh.sources import datasource

    datasource.register(spark)
    df = spark.read.format("vault").load(str(repo))
    assert {r["path"]: r["text"] for r in df.select("path", "text").collect()} == texts(repo)
    near = df.where("path like 'a/%'").select("path")
    assert [r["path"] for r in near.collect()] == ["a/old.md"]
    (repo / "new.md").write_bytes(b"x\xff")
    disk = spark.read.format("vault").option("files", "disk").option("prefix", "new").load(str(repo))
    assert [tuple(r) for r in disk.collect()] == [("new.md", "x", bytearray(b"x\xff"))]


def test_links_by_name_follow_a_nested_source(spark, repo):
    (repo / "by.md").write_text("[[old]] and [[old#t|x]]\n")
    subprocess.run(["git", "-C", str(repo), "add", "-A"], check=True)
    report = apply.apply_plan(spark, repo, PLAN, write=True, confirm=True, source_after="trash")
    assert texts(repo)["by.md"] == "[[b/new]] and [[b/new#t|x]]\n"
    manifest = apply.read_manifest(report["manifest"])
    assert manifest["tool_version"] and "by.md" in manifest["git_status_before"] and manifest["preflight"] == {"status": "passed", "issues": []}
    assert [(r["source"], r["status"], r["source_after"]) for r in manifest["reports"]] == [("a/old.md", "applied", "trash")]


def test_lost_fragment_undoes_a_commit(spark, repo):
    (repo / "a/old.md").write_text("---\nt: 1\n---\n# Head\nold text\n")
    (repo / "to.md").write_text("[[a/old#Head]]\n")
    subprocess.run(["git", "-C", str(repo), "add", "-A"], check=True)
    before = texts(repo)
    with pytest.raises(OSError, match="fragments lost: to.md #Head"):
        apply.apply_plan(spark, repo, PLAN, write=True, confirm=True)
    assert texts(repo) == before


def test_writing_needs_a_terminal(spark, repo, capsys, monkeypatch):
    (repo / "p.md").write_text("||- x\n[[in]]\n")
    subprocess.run(["git", "-C", str(repo), "add", "-A"], check=True)
    call = lambda: cli.main(["--root", str(repo), "fix-pipe", "--write", "--confirm"])
    monkeypatch.setattr("sys.stdin.isatty", lambda: False, raising=False)
    assert call() == 1 and "terminal" in capsys.readouterr().err and "||-" in (repo / "p.md").read_text()
    monkeypatch.setattr("sys.stdin.isatty", lambda: True, raising=False)
    assert call() == 0 and (repo / "p.md").read_text().startswith("|- x")


def test_reports_of_the_command_line(spark, repo, capsys):
    (repo / "30-reference/z").mkdir(parents=True)
    (repo / "30-reference/z/n.md").write_text("".join(f"[[gone{k}]]\n" for k in range(130)))
    subprocess.run(["git", "-C", str(repo), "add", "-A"], check=True)

    def call(*args):
        code = cli.main(["--root", str(repo), *args])
        return code, capsys.readouterr().out

    scan = json.loads(call("scan", "--json")[1])[0]
    assert scan["top"] == [["30-reference", 130]] and scan["subtop_30_reference"] == [["30-reference/z", 130]]
    text = call("scan")[1]
    assert "## Below 30-reference" in text and "- and 10 more" in text
    rows = [json.loads(s) for s in call("graph", "--edges", "--format", "jsonl")[1].splitlines()]
    assert {r.get("section") for r in rows} == {"hubs", "islands", "wanted", "communities", None}
    theme = json.loads(call("graph-colors", "--format", "jsonl")[1])
    assert set(theme) == {"minimum_contrast", "ok", "checks", "conflicts"} and theme["ok"] == all(r["ok"] for r in theme["checks"] + theme["conflicts"])
    v = vaults.from_git(spark, repo)
    said, lines = [], iter(["/OLD", "in.md", "no such note", ""])
    cli.browse(v, links.edges(v), lambda _: next(lines), said.append)
    assert said[0] == "a/old.md" and "in.md\t0\tanchor" in said and said[-1] == "nothing found"
