"""Renderers of results: text, JSON, JSON lines, CSV, Markdown tables and the scan report."""

from __future__ import annotations

import csv
import io
import json
from collections.abc import Iterable, Iterator
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FORMATS = ("text", "json", "jsonl")
PRIORITY_LINKS, DETAIL_LINKS = 80, 120


def rows_of(df: DataFrame) -> Iterator[dict]:
    """Rows as plain values, read partition by partition; null fields are left out."""
    return ({k: v for k, v in r.asDict(recursive=True).items() if v is not None} for r in df.toLocalIterator())


def emit(rows: Iterable[dict], fmt: str = "text") -> Iterator[str]:
    """Lines of output."""
    if fmt not in FORMATS:
        raise ValueError(f"format must be one of {FORMATS}")
    compact = {"ensure_ascii": False, "separators": (",", ":"), "allow_nan": False}
    if fmt == "json":
        yield json.dumps(list(rows), ensure_ascii=False, indent=2, allow_nan=False)
        return
    for r in rows:
        yield json.dumps(r, **compact) if fmt == "jsonl" else "\t".join(str(v) for v in r.values())


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def _cell(c: Column, kind: str) -> Column:
    if kind.startswith(("array", "struct", "map")):
        return F.to_json(c)
    return F.coalesce(c.cast("string"), F.lit(""))


def write_csv(df: DataFrame, path: str) -> None:
    """CSV files: lists as compact JSON, nulls empty."""
    df.select(*(_cell(F.col(c), k).alias(c) for c, k in df.dtypes)).write.mode("overwrite").option("header", True).option("quoteAll", False).option(
        "escape", '"'
    ).csv(path)


def csv_text(rows: Iterable[dict], columns: list[str]) -> str:
    out = io.StringIO()
    w = csv.writer(out, lineterminator="\n")
    w.writerow(columns)
    plain = lambda v: "" if v is None else str(v).lower() if isinstance(v, bool) else json.dumps(v, ensure_ascii=False, separators=(",", ":")) if isinstance(v, list) else v
    w.writerows([plain(r.get(c)) for c in columns] for r in rows)
    return out.getvalue()


def markdown_table(rows: list[dict], columns: list[str]) -> str:
    """A table, empty without rows."""
    if not rows:
        return ""

    def cell(v: object) -> str:
        text = "" if v is None else ", ".join(map(str, v)) if isinstance(v, list) else str(v).lower() if isinstance(v, bool) else str(v)
        return text.replace("\\", "\\\\").replace("|", "\\|").replace("\r\n", "\n").replace("\n", "<br>")

    lines = ["| " + " | ".join(columns) + " |", "|" + " --- |" * len(columns)]
    lines += ["| " + " | ".join(cell(r.get(c)) for c in columns) + " |" for r in rows]
    return "\n".join(lines) + "\n"


def link_lists(broken: DataFrame, most: int = DETAIL_LINKS) -> DataFrame:
    """(src, n, shown): broken links per note, the first ``most`` of them to show."""
    lists = broken.groupBy("src").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.struct("kind", "pos", "target"))).alias("l"))
    return lists.select("src", "n", F.transform(F.slice("l", 1, most), lambda x: F.concat(x["kind"], F.lit(": "), x["target"])).alias("shown"))


def scan_report(summary: dict, by_dir: list[dict], by_second: list[dict], lists: Iterable[dict], title: str, exclude: Iterable[str]) -> str:
    """Markdown report of broken links; names the prefixes that were really left out and says where a list goes on."""
    lists = sorted(lists, key=lambda r: r["src"])
    urgent = [r for r in lists if r["src"] in ("index.md", "30-reference/README.md") or r["src"].startswith(("20-areas/", "40-notes/"))]
    out = [f"# {title}", "", "## Overview", "", *(f"- {k}: {v}" for k, v in summary.items()), f"- left out: {', '.join(exclude) or 'nothing'}", ""]
    out += ["## By folder", "", markdown_table(by_dir, ["dir", "broken"])]
    out += ["## Below 30-reference", "", markdown_table(by_second, ["dir", "broken"])]
    for name, part, most in (("Priority", urgent, PRIORITY_LINKS), ("All files", lists, DETAIL_LINKS)):
        out += [f"## {name}", ""]
        for r in part:
            shown = r["shown"][:most]
            more = [f"- and {r['n'] - len(shown)} more"] if len(shown) < r["n"] else []
            out += [f"### {r['src']} ({r['n']})", "", *(f"- `{x}`" for x in shown), *more, ""]
    return "\n".join(out)


def write_report(path: str | Path, text: str) -> None:
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, "utf-8")
