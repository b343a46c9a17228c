"""Queries of the core operators: name -> f(spark, sf_dir)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkmesh.functions import color
from inkmesh.operators import dupes, graph, groups, links, orphan_refs, redirects, rewrite
from inkmesh.plans import oracle
from inkmesh.session import cut, read_table
from inkmesh.sources import vault as vaults

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL = oracle.SQL


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _vault(spark: SparkSession, sf_dir: str) -> vaults.Vault:
    return vaults.from_tables(spark, sf_dir)


def _graph(spark: SparkSession, sf_dir: str) -> tuple[vaults.Vault, DataFrame, DataFrame]:
    v = _vault(spark, sf_dir)
    return v, v.notes.select("path"), cut(links.edges(v))


def _three(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    return [read_table(spark, sf_dir, t) for t in ("links", "notes", "shared_files")]


@query
def p3_found(spark, sf_dir):
    return orphan_refs.dangling_links(*_three(spark, sf_dir)).select("link_id", "slot")


@query
def p3_report(spark, sf_dir):
    return orphan_refs.dangling_report(*_three(spark, sf_dir))


@query
def vault_stats(spark, sf_dir):
    v = _vault(spark, sf_dir)
    return graph.vault_stats(v.files, v.notes, v.dirs)


@query
def stems(spark, sf_dir):
    return _vault(spark, sf_dir).stems


@query
def notes_by_dir(spark, sf_dir):
    return _vault(spark, sf_dir).by_parent


@query
def wikilink_tokens(spark, sf_dir):
    each = links.wikilinks(_vault(spark, sf_dir))
    return each.groupBy("src", "raw").agg(F.count(F.lit(1)).alias("n"))


@query
def edges(spark, sf_dir):
    return links.edges(_vault(spark, sf_dir))


@query
def degrees(spark, sf_dir):
    _, v, e = _graph(spark, sf_dir)
    return graph.degrees(v, e)


@query
def hubs(spark, sf_dir):
    _, v, e = _graph(spark, sf_dir)
    return graph.hubs(v, e)


@query
def islands(spark, sf_dir):
    _, v, e = _graph(spark, sf_dir)
    return graph.islands(v, e, 1)


@query
def link_stats(spark, sf_dir):
    _, v, e = _graph(spark, sf_dir)
    return graph.link_stats(v, e)


def _classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, vertices, e = _graph(spark, sf_dir)
    return graph.orphan_classes(vertices, e, groups.has_any_link(v.notes))


@query
def orphan_classes(spark, sf_dir):
    return _classes(spark, sf_dir)


@query
def orphan_summary(spark, sf_dir):
    return graph.orphan_summary(_classes(spark, sf_dir))


@query
def orphan_dirs(spark, sf_dir):
    """Over the notes' own texts, without the logged links: few of these link to anything."""
    v = vaults.Vault(_living(spark, sf_dir).where("text is not null"), _vault(spark, sf_dir).files)
    vertices, e = v.notes.select("path"), cut(links.edges(v))
    return graph.orphan_dirs(graph.orphan_classes(vertices, e, groups.has_any_link(v.notes)))


@query
def wanted(spark, sf_dir):
    return links.unresolved(_vault(spark, sf_dir))


@query
def resolve_status(spark, sf_dir):
    v = _vault(spark, sf_dir)
    each = links.wikilinks(v).where("raw <> ''").select("src", "raw").distinct()
    return links.status(each, v)


@query
def scan_tokens(spark, sf_dir):
    each = links.scan_tokens(_vault(spark, sf_dir), ())
    return each.groupBy("src", "kind", "class", "target").agg(F.count(F.lit(1)).alias("n"))


@query
def scan_summary(spark, sf_dir):
    return links.scan_summary(_vault(spark, sf_dir))


@query
def broken_links(spark, sf_dir):
    return links.broken_links(_vault(spark, sf_dir), ()).groupBy("src", "kind", "target").agg(F.count(F.lit(1)).alias("n"))


@query
def broken_by_top_dir(spark, sf_dir):
    return links.broken_by_dir(_vault(spark, sf_dir), ())


@query
def broken_by_reference_dir(spark, sf_dir):
    return links.broken_by_dir(_vault(spark, sf_dir), (), "30-reference/")


@query
def broken_by_file(spark, sf_dir):
    return links.broken_by_file(_vault(spark, sf_dir))


@query
def exact_duplicates(spark, sf_dir):
    return dupes.exact_duplicates(_living(spark, sf_dir))


@query
def exact_duplicates_whole(spark, sf_dir):
    return dupes.exact_duplicates(_living(spark, sf_dir), include_frontmatter=True)


def _living(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = read_table(spark, sf_dir, "notes").where("deleted_at is null and path is not null")
    return raw.groupBy("path").agg(F.max_by("content", F.struct("created_at", "note_id")).alias("text"))


@query
def paragraph_duplicates(spark, sf_dir):
    return dupes.paragraph_duplicates(_living(spark, sf_dir)).select("sha256", "count", F.size("occurrences").cast("bigint").alias("places"), "method")


@query
def paragraph_places(spark, sf_dir):
    return dupes.repeated_places(dupes.paragraphs(_living(spark, sf_dir)), 40)


@query
def exact_members(spark, sf_dir):
    return dupes.exact_members(_living(spark, sf_dir))


@query
def line_duplicates(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), "text")
    return dupes.repeated_groups(dupes.lines(docs), 40)


def _top_hub(v: DataFrame, e: DataFrame) -> str:
    return graph.hubs(v, e, 1).first()["path"]


@query
def neighbors_d1(spark, sf_dir):
    _, v, e = _graph(spark, sf_dir)
    return graph.neighbors(v, e, [_top_hub(v, e)], 1)


@query
def neighbors_d2(spark, sf_dir):
    _, v, e = _graph(spark, sf_dir)
    return graph.neighbors(v, e, [r["path"] for r in graph.hubs(v, e, 3).collect()], 2, "outgoing")


@query
def context(spark, sf_dir):
    _, v, e = _graph(spark, sf_dir)
    return graph.context(v, e, _top_hub(v, e))


@query
def expand(spark, sf_dir):
    _, v, e = _graph(spark, sf_dir)
    hits = graph.hubs(v, e, 5).select("path", (F.col("degree") / 100.0).alias("score"))
    return graph.expand(v, e, hits, 1).select("path", "hop", "relation", "source", "anchor_score")


@query
def similar(spark, sf_dir):
    _, v, e = _graph(spark, sf_dir)
    return graph.similar(v, e, _top_hub(v, e))


@query
def similar_notes(spark, sf_dir):
    """The notes whose id is divisible by 100 are the queries, all notes are searched."""
    _, v, e = _graph(spark, sf_dir)
    asked = read_table(spark, sf_dir, "notes").where("note_id % 100 = 0 and deleted_at is null").select("path")
    return graph.similar_to(v, e, asked)


@query
def structural_links(spark, sf_dir):
    """All pairs, by classes; structural_pairs, review, plan and verify_plan are the report of the first 100."""
    _, _, e = _graph(spark, sf_dir)
    return graph.structural_links(e)


@query
def structural_pairs(spark, sf_dir):
    _, _, e = _graph(spark, sf_dir)
    return graph.structural_pairs(e)


@query
def communities(spark, sf_dir):
    _, v, e = _graph(spark, sf_dir)
    return graph.communities(v, e)


def _reviewed(spark: SparkSession, sf_dir: str) -> tuple[vaults.Vault, DataFrame]:
    v, vertices, e = _graph(spark, sf_dir)
    pairs = graph.structural_pairs(e).select("left", "right", "score")
    return v, dupes.review(pairs, v.notes, vertices, e)


@query
def review(spark, sf_dir):
    return _reviewed(spark, sf_dir)[1]


@query
def plan(spark, sf_dir):
    _, rows = _reviewed(spark, sf_dir)
    return dupes.redirect_plan(rows.withColumn("action", F.lit("redirect")))


@query
def verify_plan(spark, sf_dir):
    v, rows = _reviewed(spark, sf_dir)
    return dupes.verify_plan(dupes.redirect_plan(rows.withColumn("action", F.lit("redirect"))), v.notes)


def _reviewed_links(spark: SparkSession, sf_dir: str) -> tuple[vaults.Vault, DataFrame]:
    v, vertices, e = _graph(spark, sf_dir)
    pairs = cut(graph.structural_links(e).select("left", "right", "score", "same_class"))
    return v, dupes.review(pairs, v.notes, vertices, e)


@query
def review_links(spark, sf_dir):
    return _reviewed_links(spark, sf_dir)[1]


@query
def plan_links(spark, sf_dir):
    _, rows = _reviewed_links(spark, sf_dir)
    return dupes.redirect_plan(rows.withColumn("action", F.lit("redirect")))


@query
def verify_plan_links(spark, sf_dir):
    v, rows = _reviewed_links(spark, sf_dir)
    return dupes.verify_plan(dupes.redirect_plan(rows.withColumn("action", F.lit("redirect"))), v.notes)


@query
def group_sizes(spark, sf_dir):
    v, _, e = _graph(spark, sf_dir)
    return groups.group_sizes(v, e)


@query
def group_topk(spark, sf_dir):
    v, _, e = _graph(spark, sf_dir)
    return groups.suggest(v, e, 20).select("name", "kind", "value", "obsidian_query", "property_query", "requires_tool", "tool_command", "count")


@query
def fragments(spark, sf_dir):
    each = redirects.verify_fragments(_vault(spark, sf_dir))
    return each.groupBy("file", "target", "fragment", "status", "candidates", "ok").agg(F.count(F.lit(1)).alias("n"))


@query
def redirect_check(spark, sf_dir):
    return redirects.verify_redirects(_vault(spark, sf_dir))


def _moves(v: vaults.Vault) -> DataFrame:
    """Every note moves to a folder of the same name with 'moved/' before it."""
    bare = F.regexp_replace("path", r"\.md$", "")
    return v.notes.select(bare.alias("old"), F.concat(F.lit("moved/"), bare).alias("new"))


@query
def preflight(spark, sf_dir):
    v = _vault(spark, sf_dir)
    return redirects.preflight(v, _moves(v)).groupBy("file", "raw", "status").agg(F.count(F.lit(1)).alias("n"))


@query
def migration_stats(spark, sf_dir):
    v = _vault(spark, sf_dir)
    return redirects.migration_stats(v, _moves(v))


@query
def migrate_links(spark, sf_dir):
    v = _vault(spark, sf_dir)
    return rewrite.migrate_links(v.notes, _moves(v)).select("path", F.sha2("new_text", 256).alias("sha256"))


@query
def frontmatter_tags(spark, sf_dir):
    return groups.frontmatter(_living(spark, sf_dir)).select("path", F.explode("tags").alias("tag"))


@query
def note_aliases(spark, sf_dir):
    return rewrite.aliases(_living(spark, sf_dir))


@query
def titles(spark, sf_dir):
    return _living(spark, sf_dir).where("text is not null").select("path", rewrite.title(F.col("text")).alias("title"))


def _twins(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Notes and a plan: of notes with the same normal content, all point to the first."""
    notes = _living(spark, sf_dir)
    same = dupes.exact_members(notes)
    first = same.groupBy("sha256").agg(F.min("path").alias("target"))
    return notes, same.join(first, "sha256").where("path <> target").select(F.col("path").alias("source"), "target")


@query
def redirect_stubs(spark, sf_dir):
    notes, moves = _twins(spark, sf_dir)
    return rewrite.redirect_stubs(moves, notes).select("path", "new_text")


@query
def merge_drafts(spark, sf_dir):
    notes, moves = _twins(spark, sf_dir)
    return rewrite.merge_drafts(moves, notes)


@query
def alias_collisions(spark, sf_dir):
    """A plan that gives every alias in use to the first note of all."""
    notes = _living(spark, sf_dir).where("text is not null")
    first = notes.agg(F.min("path").alias("target"))
    moves = rewrite.aliases(notes).select(F.concat(F.lit("old/"), "alias", F.lit(".md")).alias("source")).distinct().join(F.broadcast(first))
    return rewrite.alias_collisions(moves, notes)


@query
def fix_pipes(spark, sf_dir):
    """Over the logged targets of each source, every one as a line behind stray pipes of all kinds."""
    raw = F.regexp_replace("raw", r"[\r\n]", " ")
    heads = F.array(*(F.concat(F.lit(h), raw, F.lit(t)) for h, t in (("|", ""), ("||", ""), ("| ", " |"), ("|| ", " |"), ("||-", ""), ("| ---", ""), ("", "|"))))
    each = read_table(spark, sf_dir, "links").where("raw is not null and src is not null").select("link_id", F.col("src").alias("path"), heads.alias("h"))
    blocks = each.groupBy("path").agg(F.array_sort(F.collect_set(F.struct("link_id", "h"))).alias("b"))
    lines = F.flatten(F.transform("b", lambda x: F.concat(x["h"], F.array(F.lit("|"), F.lit("||")))))
    notes = blocks.select("path", F.concat(F.array_join(lines, "\n"), F.lit("\n")).alias("text"))
    return rewrite.fix_pipes(notes).select("path", "changes", F.sha2("new_text", 256).alias("sha256"))


@query
def fix_unlinked(spark, sf_dir):
    return rewrite.fix_unlinked(_vault(spark, sf_dir)).select("path", F.sha2("new_text", 256).alias("sha256"))


@query
def tidy_articles(spark, sf_dir):
    out = rewrite.tidy_articles(_living(spark, sf_dir).where("text is not null"), "2025")
    return out.select("path", "error", F.sha2("new_text", 256).alias("sha256"))


@query
def contrast_report(spark, sf_dir):
    out = None
    for name in color.PALETTES:
        rows = color.contrast_checks(spark, color.palette(name)).withColumn("theme", F.lit(name))
        out = rows if out is None else out.unionByName(rows)
    return out
