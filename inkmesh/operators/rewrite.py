"""Text transforms: notes -> (path, old_text, new_text) of notes that change. Nothing is written here."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkmesh.functions import markdown as md
from inkmesh.functions.paths import basename, parent, stem
from inkmesh.functions.text import newlines, split_lines, strip_ws
from inkmesh.operators.groups import head_block
from inkmesh.sources.vault import Vault

_TOKENS = re.compile(r"`[^`\n]*`|(!?\[\[)([^\]\n]+)\]\]|(?<!!)\[([^\]\n]+)\]\(([^)\n]+)\)")
_FENCE = re.compile(r"\s*(?:```|~~~)")


def changed(df: DataFrame) -> DataFrame:
    return df.where("new_text <> old_text").select("path", "old_text", "new_text")


def rewrite_text(text: str, new: dict[str, str]) -> str:
    """Links outside code whose base is a key of ``new`` get its value; alias, fragment and embed stay."""

    def swap(m: re.Match) -> str:
        if m[2] is not None:
            target, bar, alias = m[2].partition("|")
            base, mark, fragment = target.partition("#")
            to = new.get(base) or new.get(f"{base}.md")
            return m[0] if not to else f"{m[1]}{to}{mark}{fragment}{bar}{alias}]]"
        if m[4] is not None:
            base, mark, fragment = m[4].partition("#")
            to = new.get(base) or new.get(base.removesuffix(".md"))
            return m[0] if not to else f"[{m[3]}]({to}{mark}{fragment})"
        return m[0]

    out, fenced = [], False
    for line in text.splitlines(keepends=True):
        mark = bool(_FENCE.match(line))
        fenced ^= mark
        out.append(line if mark or fenced else _TOKENS.sub(swap, line))
    return "".join(out)


def migrate_links(notes: DataFrame, mapping: DataFrame) -> DataFrame:
    """Rewrite links by a mapping (old, new) of any size.

    The bases each note uses are joined to the mapping, so a note's task sees only the entries
    it needs.
    """
    wiki = F.transform(md.wiki_bodies(F.col("text"), md.ANY_WIKI_LINK), lambda b: F.substring_index(F.substring_index(b, "|", 1), "#", 1))
    plain = F.transform(F.regexp_extract_all(F.col("text"), F.lit(md.PLAIN_MD_LINK), F.lit(2)), lambda b: F.substring_index(b, "#", 1))
    more = lambda a, f: F.concat(a, F.transform(a, f))
    bases = F.array_distinct(
        F.concat(more(wiki, lambda b: F.concat(b, F.lit(".md"))), more(plain, lambda b: F.regexp_replace(b, r"\.md$", "")))
    )
    used = notes.select("path", F.explode(bases).alias("old")).join(mapping.select("old", "new"), "old")
    maps = used.groupBy("path").agg(F.map_from_entries(F.collect_set(F.struct("old", "new"))).alias("m"))

    @F.udf("string", useArrow=True)
    def rewrite(text: str, m) -> str:
        return rewrite_text(text, dict(m))

    full = notes.join(maps, "path")
    return changed(full.select("path", F.col("text").alias("old_text"), rewrite("text", "m").alias("new_text")))


def alias_text(text: str, alias: str) -> str:
    """Add an alias inside the list of the head block; scalar lists are rejected, no head block: unchanged."""
    end = text.find("\n---\n", 4) if text.startswith("---\n") else -1
    if end < 0:
        return text
    lines = text[4:end].split("\n") if end > 4 else []
    at = next((i for i, s in enumerate(lines) if re.match(r"aliases[ \t]*:", s)), None)
    if at is None:
        lines += ["aliases:", f"  - {alias}"]
    else:
        value = lines[at].split(":", 1)[1].strip()
        if value.startswith("[") and value.endswith("]"):
            own = [v.strip() for v in value[1:-1].split(",") if v.strip()]
            if alias in own:
                return text
            lines[at] = f"aliases: [{', '.join([*own, alias])}]"
        elif value:
            raise ValueError("aliases must be a list")
        else:
            stop = at + 1
            while stop < len(lines) and re.match(r"\s*-\s", lines[stop]):
                if lines[stop].strip()[1:].strip() == alias:
                    return text
                stop += 1
            lines.insert(stop, f"  - {alias}")
    return "---\n" + "\n".join(lines) + text[end:]


def aliases(notes: DataFrame) -> DataFrame:
    """(path, alias) of the head blocks' lists."""

    @F.udf("array<string>", useArrow=True)
    def read(block: str):
        import yaml

        try:
            meta = yaml.safe_load(block)
        except yaml.YAMLError:
            return []
        own = meta.get("aliases") if isinstance(meta, dict) else None
        return [str(a) for a in own if a is not None] if isinstance(own, list) else []

    return notes.select("path", head_block(F.col("text")).alias("b")).where("b is not null").select("path", F.explode(read("b")).alias("alias"))


def alias_collisions(plan: DataFrame, notes: DataFrame) -> DataFrame:
    """(source, target, alias, path) where another note than the target already has the source's name as alias."""
    wanted = plan.select("source", "target", stem(F.col("source")).alias("alias"))
    return wanted.join(aliases(notes), "alias").where(~F.endswith("path", F.col("target"))).select("source", "target", "alias", "path")


def stub_text(text: Column, target: Column) -> Column:
    """A redirect: the head block kept, then one line."""
    block = head_block(text)
    head = F.when(block.isNotNull(), F.concat(F.lit("---\n"), block, F.lit("\n---\n\n"))).otherwise(F.lit(""))
    return F.concat(head, F.lit("> Moved to [["), F.regexp_replace(target, r"\.md$", ""), F.lit("]].\n"))


def redirect_stubs(plan: DataFrame, notes: DataFrame) -> DataFrame:
    rows = plan.select(F.col("source").alias("path"), "target").join(notes, "path")
    return changed(rows.select("path", F.col("text").alias("old_text"), stub_text(F.col("text"), F.col("target")).alias("new_text")))


def merge_drafts(plan: DataFrame, notes: DataFrame) -> DataFrame:
    """(path, text): drafts of both notes' texts, named after the target; one draft per stem, the last source wins."""
    side = lambda s: notes.select(F.col("path").alias(s), F.col("text").alias(f"{s}_text"))
    rows = plan.select("source", "target").join(side("source"), "source").join(side("target"), "target")
    mark = F.concat(F.lit("\n\n<!-- merged from "), F.col("source"), F.lit(" -->\n\n"))
    draft = rows.select(
        F.concat(stem(F.col("target")), F.lit(".merge-draft.md")).alias("path"), "source", F.concat("target_text", mark, "source_text").alias("text")
    )
    return draft.groupBy("path").agg(F.max_by("text", "source").alias("text"))


def _pipe_line(s: Column) -> Column:
    """Rules for stray pipes at the head of a line, the first that fits."""
    table = lambda x: x.startswith("| ") & (x.substr(F.lit(3), F.length(x)).contains(" |") | x.rlike(r"(?U)^\| \s*---"))
    dashes = lambda x: x.rlike(r"(?U)^\s*---")
    one, two = F.substring(s, F.lit(2), F.length(s)), F.substring(s, F.lit(3), F.length(s))
    return (
        F.when(s == "|", F.lit(""))
        .when(s.startswith("||-"), one)
        .when(s.startswith("||") & (table(one) | dashes(one)), one)
        .when(s.startswith("||"), F.when(strip_ws(two) == "", F.lit("")).otherwise(two))
        .when(s.startswith("|") & ~table(s) & ~dashes(one), one)
        .otherwise(s)
    )


def fix_pipes(notes: DataFrame) -> DataFrame:
    """(path, old_text, new_text, changes) of notes with stray pipes; the final newline stays."""
    lines = F.split(newlines(F.col("text")), "\n", -1)
    new = F.transform(lines, _pipe_line)
    n = F.aggregate(F.zip_with(lines, new, lambda a, b: (a != b).cast("int")), F.lit(0), lambda a, x: a + x)
    rows = notes.where(F.contains("text", F.lit("|"))).select("path", F.col("text").alias("old_text"), F.array_join(new, "\n").alias("new_text"), n.alias("changes"))
    return rows.where("changes > 0")


def sync_counts(notes: DataFrame, paths: list[str], count: int) -> DataFrame:
    """Set the first 'N MD' of the named notes to a count."""
    new = F.regexp_replace("text", r"(?Us)^(.*?)\d+\s*MD", f"$1{int(count)} MD")
    own = F.regexp_extract("text", r"(?U)(\d+)\s*MD", 1)
    rows = notes.where(F.col("path").isin(paths) & (own != "") & (own.cast("bigint") != count))
    return changed(rows.select("path", F.col("text").alias("old_text"), new.alias("new_text")))


# Fixed value: a dated list line with a Markdown link.
DATED = r"^(- \d{4}-\d{2}-\d{2} )\[([^\]]+)\]\(([^)]+)\)( — .*)$"


def convert_links(notes: DataFrame, mapping: DataFrame) -> DataFrame:
    """(path, old_text, new_text, converted, missing): dated Markdown links become wikilinks by a mapping (old, new)."""
    lines = F.split(F.col("text"), "\n", -1)
    old = lambda s: F.regexp_extract(s, DATED, 3)
    each = notes.withColumn("dated", F.array_distinct(F.filter(F.transform(lines, old), lambda x: x != ""))).where(F.size("dated") > 0)
    used = each.select("path", F.explode("dated").alias("old")).join(mapping.select("old", "new"), "old")
    maps = used.groupBy("path").agg(F.map_from_entries(F.collect_set(F.struct("old", "new"))).alias("m"))
    full = each.join(maps, "path", "left").withColumn("m", F.coalesce("m", F.create_map().cast("map<string,string>")))
    to = lambda s: F.try_element_at(F.col("m"), old(s))
    link = lambda s: F.concat(F.regexp_extract(s, DATED, 1), F.lit("[["), to(s), F.lit("|"), F.regexp_extract(s, DATED, 2), F.lit("]]"), F.regexp_extract(s, DATED, 4))
    new = F.transform(lines, lambda s: F.coalesce(F.when(old(s) != "", link(s)), s))
    hits = F.filter(F.transform(lines, old), lambda x: x != "")
    done = F.size(F.filter(hits, lambda x: F.try_element_at(F.col("m"), x).isNotNull()))
    return full.select(
        "path", F.col("text").alias("old_text"), F.array_join(new, "\n").alias("new_text"), done.alias("converted"), (F.size(hits) - done).alias("missing")
    )


# Head fields that the archive's tidying writes itself, and its marks.
MANAGED = {"source_file", "tags", "parent", "topic", "decision"}
IMPORT_LINE = r"^-\s*导入来源:.*(?:\n|$)"
BACKLINK_TEXT = "← 返回索引"
RELATED_HEADING = "## 关联"


def scalar(value: object) -> str:
    """A YAML scalar."""
    if isinstance(value, str) or value is None or isinstance(value, bool):
        return json.dumps(value, ensure_ascii=False)
    return str(value)


def tidy_text(text: str, year: str, entry: dict | None) -> str:
    """An archived article with its managed fields, import line and backlink written anew."""
    end = text.find("\n---", 3)
    head = re.match(r"---\n(.*?)\n---\n?", text, re.DOTALL)
    if end < 0 or head is None:
        raise ValueError("missing YAML frontmatter")
    entry = {} if entry is None else entry
    if not isinstance(entry, dict):
        raise ValueError("coverage entry must be an object")
    kept = [s for s in head[1].splitlines() if s.partition(":")[0].strip() not in MANAGED or ":" not in s]
    kept += ["tags: [wechat-archive]", f"parent: [[index-{year}]]"]
    kept += [f"{k}: {scalar(entry[k])}" for k in ("topic", "decision") if (entry.get(k) if k == "topic" else k in entry)]
    link = f"[[index-{year}|{BACKLINK_TEXT}]]"
    rest = re.sub(IMPORT_LINE, "", text[head.end() :], flags=re.MULTILINE).replace(link, "")
    rest = re.sub(r"\n{3,}", "\n\n", rest).rstrip()
    return "\n".join(["---", *kept, "---", rest, "", link, ""])


def tidy_articles(notes: DataFrame, year: str, coverage: DataFrame | None = None) -> DataFrame:
    """(path, old_text, new_text, error) of articles; an article that fails keeps its text and says why.

    coverage: (key, entry) with the entry as JSON, keyed articles/<year>/<name>.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for path, text, entry in zip(pdf["path"], pdf["text"], pdf["entry"], strict=True):
                try:
                    out.append((path, text, tidy_text(text, year, json.loads(entry) if isinstance(entry, str) else None), None))
                except ValueError as e:
                    out.append((path, text, text, str(e)))
            yield pd.DataFrame(out, columns=["path", "old_text", "new_text", "error"])

    rows = notes.select("path", "text").withColumn("key", F.concat(F.lit(f"articles/{year}/"), basename(F.col("path"))))
    rows = rows.join(coverage, "key", "left") if coverage is not None else rows.withColumn("entry", F.lit(None).cast("string"))
    return rows.mapInPandas(run, "path string, old_text string, new_text string, error string")


# Hub notes that exist by convention.
ROOT_HUBS = ("10-projects", "20-areas", "30-reference", "40-notes", "50-diary", "60-archive", "graph")
THEME_HUBS = (
    "30-reference/security",
    "30-reference/workflows",
    "30-reference/references",
    "30-reference/music",
    "30-reference/linux",
    "30-reference/rust",
    "30-reference/computing-systems",
    "40-notes",
    "40-notes/writing",
    "40-notes/kb-maintenance",
    "40-notes/weread",
    "20-areas/tools",
    "20-areas/snippets",
    "20-areas/arch",
    "50-diary",
    "60-archive",
)


def default_links(vault: Vault, targets: DataFrame) -> DataFrame:
    """(path, rank, link): up to three links for notes (path) without any.

    In order: README of the own folder, of the one above, hub of the first folder, hubs of
    enclosing themes, the second and the first sibling, then index and README while there are
    fewer than two. Hubs and the last two are taken as they are, README notes must exist.
    """
    p, own = F.col("path"), parent(F.col("path"))
    readmes = vault.notes.where(basename(p) == "README.md").select(parent(p).alias("at"), F.lit(True).alias("there"))
    first = Window.partitionBy("dir").orderBy("path")
    siblings = vault.notes.where(basename(p) != "README.md").select(p, own.alias("dir")).withColumn("r", F.row_number().over(first)).where("r <= 3")
    three = siblings.groupBy("dir").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "path"))), lambda x: x["path"]).alias("sib"))
    rows = targets.select(p, own.alias("dir"), parent(own).alias("up"))
    rows = rows.join(readmes.select(F.col("at").alias("dir"), F.col("there").alias("own_readme")), "dir", "left")
    rows = rows.join(readmes.select(F.col("at").alias("up"), F.col("there").alias("up_readme")), "up", "left").join(three, "dir", "left")
    readme = lambda d: F.when(d == "", F.lit("README")).otherwise(F.concat(d, F.lit("/README")))
    others = F.filter(F.coalesce("sib", F.array().cast("array<string>")), lambda x: x != F.col("path"))
    top = F.substring_index("path", "/", 1)
    bare = lambda x: F.regexp_replace(x, r"\.md$", "")
    links = F.array(
        F.when(F.col("own_readme"), readme(F.col("dir"))),
        F.when(F.col("up_readme"), readme(F.col("up"))),
        F.when(top.isin(*ROOT_HUBS), F.concat(top, F.lit("/README"))),
        *(F.when(F.col("path").startswith(f"{h}/"), F.lit(f"{h}/README")) for h in THEME_HUBS),
        bare(F.get(others, F.lit(1))),
        bare(F.get(others, F.lit(0))),
    )
    found = F.array_distinct(F.array_compact(links))
    index = F.when(F.size("l") < 2, F.array_distinct(F.concat("l", F.array(F.lit("index"))))).otherwise(F.col("l"))
    rows = rows.select("path", found.alias("l")).withColumn("l", index)
    rows = rows.withColumn("l", F.when(F.size("l") < 2, F.array_distinct(F.concat("l", F.array(F.lit("README"))))).otherwise(F.col("l")))
    return rows.select("path", F.posexplode(F.slice("l", 1, 3)).alias("rank", "link"))


def title(text: Column) -> Column:
    """First heading of level one within 60 lines."""
    heads = F.filter(F.slice(split_lines(text), 1, 60), lambda s: s.startswith("# "))
    return strip_ws(F.substring(F.get(heads, F.lit(0)), F.lit(3), F.length(F.get(heads, F.lit(0)))))


def fix_unlinked(vault: Vault) -> DataFrame:
    """Give notes without any wikilink a section of related notes."""
    bare = vault.notes.where(~F.contains("text", F.lit("[[")) & (basename(F.col("path")) != "README.md"))
    links = default_links(vault, bare)
    titles = vault.notes.select(F.regexp_replace("path", r"\.md$", "").alias("link"), title(F.col("text")).alias("title"))
    shown = F.coalesce("title", F.replace(basename(F.col("link")), F.lit("-"), F.lit(" ")))
    lines = links.join(titles, "link", "left").withColumn("line", F.concat(F.lit("- [["), "link", F.lit("|"), shown, F.lit("]]")))
    added = lines.groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "line"))), lambda x: x["line"]), "\n").alias("more"))
    rows = bare.join(added, "path")
    text = F.when(F.col("text").endswith("\n"), F.col("text")).otherwise(F.concat("text", F.lit("\n")))
    has = F.col("text").rlike(rf"(?Um)^{RELATED_HEADING}\s*$")
    head = F.when(has, F.lit("")).otherwise(F.lit(f"\n{RELATED_HEADING}\n\n"))
    return changed(rows.select("path", F.col("text").alias("old_text"), F.concat(text, head, "more", F.lit("\n")).alias("new_text")))


def diff(changes: DataFrame) -> DataFrame:
    """(path, diff): unified diffs of changes."""

    @F.udf("string", useArrow=True)
    def unified(path: str, old: str, new: str) -> str:
        import difflib

        return "".join(difflib.unified_diff(old.splitlines(True), new.splitlines(True), f"a/{path}", f"b/{path}"))

    return changes.select("path", unified("path", "old_text", "new_text").alias("diff"))


