"""Command line: python -m inkmesh.cli COMMAND. A thin last step over the operators."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkmesh import analyzers
from inkmesh.config import ConfigError, load_config, pick
from inkmesh.functions import color
from inkmesh.operators import apply, dupes, graph, groups, links, redirects, rewrite
from inkmesh.session import get_spark, ship
from inkmesh.sources import records, sinks, vault as vaults


def _parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="inkmesh", description=__doc__)
    top.add_argument("--root", help="folder of the vault")
    top.add_argument("--config")
    sub = top.add_subparsers(dest="command", required=True)

    def add(name: str, *args: tuple, fmt: bool = True) -> None:
        p = sub.add_parser(name)
        for flags, kw in args:
            p.add_argument(*flags, **kw)
        if fmt:
            p.add_argument("--format", choices=(*sinks.FORMATS, "csv", "md"), default="text")

    def opt(*flags: str, **kw) -> tuple:
        return flags, kw

    n = lambda flag, default: opt(flag, type=int, default=default)
    write = [opt("--write", action="store_true"), opt("--confirm", action="store_true")]
    way = opt("--direction", choices=graph.DIRECTIONS, default="both")
    add("scan", opt("--exclude", action="append"), opt("--out"), opt("--title", default="Broken links"), opt("--json", action="store_true"), fmt=False)
    add("orphan", opt("--json", action="store_true"), n("--limit", None), fmt=False)
    add("fix-zero", *write)
    add("fix-pipe", *write)
    add("sync", opt("--index"), *write)
    add("convert-links", opt("index"), opt("mapping"), *write)
    add("tidy", opt("articles"), opt("year"), opt("--coverage"), *write)
    add("graph", opt("-m", "--mode", choices=("islands", "hubs", "wanted", "communities", "all"), default="all"), n("--top", 20), n("--min-links", 0), opt("--edges", action="store_true"))
    add("neighbors", opt("anchors", nargs="+"), n("--depth", 1), way, n("--limit", None))
    add("expand", n("--depth", 1), way, n("--limit", 50))
    add("context", opt("anchors", nargs="+"), n("--depth", 1), n("--limit", 50))
    add("similar", opt("note"), n("--top", 10))
    add("dedupe-scan", opt("--threshold", type=float, default=0.25), n("--limit", 100))
    add("dedupe-exact", opt("--include-frontmatter", action="store_true"), n("--limit", None))
    add("dedupe-paragraphs", n("--min-chars", 40))
    add("dedupe-review", opt("candidates"))
    add("dedupe-plan", opt("reviewed"))
    add("dedupe-apply", opt("plan"), opt("--source-after", choices=apply.AFTER, default="redirect"), opt("--require-clean-git", action="store_true"), *write)
    add("dedupe-verify", opt("plan"))
    add("dedupe-rollback", opt("manifest"), *write)
    add("dedupe-verify-manifest", opt("manifest"))
    add("dedupe-verify-fragments")
    add("dedupe-verify-redirects")
    add("dedupe-merge-draft", opt("plan"), opt("--out", default="."))
    add("graph-colors", opt("--theme"), opt("--min-contrast", type=float), opt("--css"))
    add("graph-groups", opt("--theme"), n("--limit", None), n("--min-count", None))
    add("stats")
    add("plugins")
    add("analyze", opt("name"))
    add("browse", fmt=False)
    return top


def _allowed(a: argparse.Namespace) -> bool:
    """Whether to write: asked for, confirmed, and with a person at the terminal."""
    if getattr(a, "write", False) and a.confirm and not sys.stdin.isatty():
        raise ValueError("refusing to modify files without an interactive terminal")
    return getattr(a, "write", False)


def _write(root: Path, changes: DataFrame, a: argparse.Namespace) -> list[dict]:
    """Diffs of changes; written too with --write and --confirm."""
    changes = changes.cache()
    rows = list(sinks.rows_of(rewrite.diff(changes).orderBy("path")))
    if _allowed(a):
        apply.write_changes(root, changes, a.confirm)
    return rows


def browse(v: vaults.Vault, edges: DataFrame, read=input, show=print) -> None:
    """A prompt over the graph: a note's path shows its neighbours, /text finds paths, an empty line ends."""
    paths = v.notes.select("path")
    while line := read("note, /part of a path, or nothing to leave: ").strip():
        if line.startswith("/"):
            hits = paths.where(F.contains(F.lower("path"), F.lit(line[1:].lower()))).orderBy("path").limit(20)
        else:
            hits = graph.context(paths, edges, line)
        rows = [list(r) for r in hits.collect()]
        for r in rows or [["nothing found"]]:
            show("\t".join(map(str, r)))


def run(a: argparse.Namespace) -> tuple[object, int]:
    """(rows or text, exit code) of one command."""
    root = vaults.vault_root(a.root)
    if a.command == "plugins":
        return [{"name": n, "value": v} for n, v in analyzers.listed()], 0
    cfg = load_config(root, a.config)
    spark = get_spark()
    ship(spark)
    if a.command == "graph-colors":
        colors = color.palette(pick(a.theme, cfg.theme, "default"))
        report = color.theme_report(spark, colors, pick(a.min_contrast, cfg.min_contrast, 2.0))
        if a.css:
            sinks.write_report(a.css, color.render_css(colors))
        return [report], int(not report["ok"])
    if a.command == "dedupe-rollback":
        rows = apply.rollback(root, a.manifest, _allowed(a), a.confirm)
        return rows, int(not all(r["ok"] for r in rows))
    if a.command == "dedupe-verify-manifest":
        rows = apply.verify_manifest(root, a.manifest)
        return rows, int(not all(r["ok"] for r in rows))
    if a.command in ("dedupe-exact", "dedupe-paragraphs"):
        notes = vaults.from_disk(spark, root).notes
        found = dupes.exact_duplicates(notes, a.include_frontmatter, a.limit) if a.command == "dedupe-exact" else dupes.paragraph_duplicates(notes, a.min_chars)
        return sinks.rows_of(found), 0
    if a.command == "dedupe-plan":
        return sinks.rows_of(dupes.redirect_plan(records.read_records(spark, a.reviewed))), 0
    if a.command == "dedupe-apply":
        plan = list(sinks.rows_of(records.read_records(spark, a.plan)))
        try:
            return [apply.apply_plan(spark, root, plan, _allowed(a), a.confirm, a.source_after, a.require_clean_git)], 0
        except apply.PreflightError as e:
            return e.issues, 1
    if a.command in ("convert-links", "tidy"):
        base = Path(a.index).parent if a.command == "convert-links" else Path(a.articles)
        if a.command == "tidy":
            notes = vaults.read_texts(spark, base, sorted(p.name for p in base.glob("*.md")))
            done = rewrite.tidy_articles(notes, a.year, records.read_coverage(spark, a.coverage) if a.coverage else None)
            bad = list(sinks.rows_of(done.where("error is not null").select("path", "error")))
            return [*_write(base, rewrite.changed(done), a), *bad], int(bool(bad))
        notes = vaults.read_texts(spark, base, [Path(a.index).name])
        done = rewrite.convert_links(notes, records.read_mapping(spark, a.mapping)).cache()
        missing = done.agg(F.sum("missing")).first()[0] or 0
        return _write(base, rewrite.changed(done), a), int(missing > 0)
    if not (root / ".git").exists():
        raise ValueError(f"{root} is no git repository")
    v = vaults.from_git(spark, root).cache()
    paths = v.notes.select("path")
    if a.command == "scan":
        exclude = tuple(a.exclude) if a.exclude else None
        broken = links.broken_links(v, exclude).cache()
        summary = links.scan_summary(v, exclude).first().asDict()
        if a.json:
            tops = lambda under=None: [list(r) for r in links.top_dirs(broken, under).collect()]
            return [summary | {"top": tops(), "subtop_30_reference": tops("30-reference/")}], 0
        lists = list(sinks.rows_of(sinks.link_lists(broken)))
        dirs, second = (list(sinks.rows_of(links.top_dirs(broken, under, None))) for under in (None, "30-reference/"))
        text = sinks.scan_report(summary, dirs, second, lists, a.title, vaults.SCAN_EXCLUDES if exclude is None else exclude)
        if a.out:
            sinks.write_report(a.out, text)
        return text, 0
    if a.command == "fix-zero":
        return _write(root, rewrite.fix_unlinked(v), a), 0
    if a.command == "fix-pipe":
        return _write(root, rewrite.fix_pipes(v.notes), a), 0
    if a.command == "sync":
        return _write(root, rewrite.sync_counts(v.notes, ["README.md", *([a.index] if a.index else [])], v.notes.count()), a), 0
    if a.command == "stats":
        return sinks.rows_of(graph.vault_stats(v.files, v.notes, v.dirs)), 0
    if a.command == "analyze":
        return analyzers.run(a.name, v), 0
    if a.command == "dedupe-verify-fragments":
        return sinks.rows_of(redirects.verify_fragments(v)), 0
    if a.command == "dedupe-verify-redirects":
        return sinks.rows_of(redirects.verify_redirects(v)), 0
    if a.command in ("dedupe-verify", "dedupe-merge-draft"):
        plan = records.read_records(spark, a.plan)
        if a.command == "dedupe-verify":
            rows = list(sinks.rows_of(dupes.verify_plan(plan, v.notes)))
            return rows, int(not all(r["ok"] for r in rows))
        drafts = list(sinks.rows_of(rewrite.merge_drafts(plan, v.notes)))
        for d in drafts:
            apply.write_atomic(Path(a.out) / d["path"], d["text"].encode())
        return [{"path": d["path"]} for d in drafts], 0
    edges = links.edges(v).cache()
    if a.command == "orphan":
        classes = graph.orphan_classes(paths, edges, groups.has_any_link(v.notes)).cache()
        often = graph.orphan_dirs(classes).where("zero_both >= 5").orderBy(F.col("zero_both").desc(), "dir")
        return [*sinks.rows_of(graph.orphan_summary(classes)), *sinks.rows_of(often), *sinks.rows_of(graph.orphan_notes(classes, a.limit))], 0
    if a.command == "browse":
        browse(v, edges)
        return [], 0
    by_mode = {
        "islands": lambda: graph.islands(paths, edges, a.min_links),
        "hubs": lambda: graph.hubs(paths, edges, a.top),
        "wanted": lambda: links.unresolved(v).orderBy(F.col("references").desc(), "target").limit(a.top),
        "communities": lambda: graph.community_report(graph.communities(paths, edges)),
    }
    if a.command == "graph":
        shown = ["hubs", "islands", "wanted", "communities"] if a.mode == "all" else [a.mode]
        rows = [{**r, **({"section": m} if a.mode == "all" else {})} for m in shown for r in sinks.rows_of(by_mode[m]())]
        first = edges.orderBy("src", "dst").limit(100) if a.edges else None
        return [*rows, *(sinks.rows_of(first) if first is not None else [])], 0
    by_command = {
        "neighbors": lambda: graph.neighbors(paths, edges, a.anchors, a.depth, a.direction, a.limit),
        "expand": lambda: graph.expand(paths, edges, spark.createDataFrame(records.parse_records(sys.stdin.read())), a.depth, a.direction, a.limit),
        "context": lambda: graph.context(paths, edges, a.anchors, a.depth, a.limit),
        "similar": lambda: graph.similar(paths, edges, a.note, a.top),
        "dedupe-scan": lambda: graph.structural_pairs(edges, a.threshold, a.limit),
        "dedupe-review": lambda: dupes.review(records.read_records(spark, a.candidates), v.notes, paths, edges),
        "graph-groups": lambda: groups.suggest(
            v, edges, pick(a.limit, cfg.limit, 50), pick(a.theme, cfg.groups_theme, "default"), pick(a.min_count, cfg.min_count, 1)
        ),
    }
    return sinks.rows_of(by_command[a.command]()), 0


def main(argv: list[str] | None = None) -> int:
    a = _parser().parse_args(argv)
    try:
        out, code = run(a)
    except (ConfigError, ValueError, analyzers.AnalyzerError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    fmt = getattr(a, "format", "text")
    if isinstance(out, str):
        print(out)
    elif isinstance(out, dict):
        print(json.dumps(out, ensure_ascii=False))
    elif fmt in ("csv", "md"):
        rows = list(out)
        columns = list(dict.fromkeys(k for r in rows for k in r))
        print(sinks.csv_text(rows, columns) if fmt == "csv" else sinks.markdown_table(rows, columns), end="")
    else:
        for line in sinks.emit(out, "json" if getattr(a, "json", False) else fmt):
            print(line)
    return code


if __name__ == "__main__":
    sys.exit(main())
