"""Group suggestions by folder, frontmatter and graph health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkmesh.functions import markdown as md
from inkmesh.functions.color import group_palette
from inkmesh.functions.paths import parent
from inkmesh.functions.text import FM_CLOSE, FM_OPEN
from inkmesh.operators.graph import degrees
from inkmesh.operators.links import status, wikilinks
from inkmesh.sources.vault import Vault

HUB_DEGREE = 10
# The commands that list the members of health groups.
COMMANDS = {"orphan": "inkmesh orphan", "hub": "inkmesh graph -m hubs", "broken-link": "inkmesh scan"}


def head_block(text: Column) -> Column:
    """The YAML between the head marks, null without."""
    end = F.locate(FM_CLOSE, text, 5)
    return F.when(text.startswith(FM_OPEN) & (end > 0), F.substring(text, F.lit(5), end - 5))


def frontmatter(notes: DataFrame, strict: bool = False) -> DataFrame:
    """(path, tags, fields) of notes with a head block.

    fields holds ``type`` and ``status`` where they are scalars, tags the normalised tags. YAML
    that cannot be read gives nothing, or raises if ``strict``.
    """

    @F.udf("struct<tags:array<string>,fields:map<string,string>>", useArrow=True)
    def read(block: str):
        import yaml

        try:
            meta = yaml.safe_load(block)
        except yaml.YAMLError:
            if strict:
                raise
            meta = None
        meta = meta if isinstance(meta, dict) else {}
        tags = meta.get("tags", meta.get("tag"))
        tags = [tags] if isinstance(tags, (str, int, float)) else tags
        tags = [str(t).lstrip("#").strip() for t in tags if str(t).strip()] if isinstance(tags, list) else []
        fields = {k: str(meta[k]) for k in ("type", "status") if meta.get(k) is not None and not isinstance(meta[k], (dict, list))}
        return {"tags": tags, "fields": fields}

    heads = notes.select("path", head_block(F.col("text")).alias("block")).where("block is not null")
    return heads.select("path", read("block").alias("m")).select("path", "m.tags", "m.fields")


def memberships(vault: Vault, edges: DataFrame, parity: bool = False, strict: bool = False) -> DataFrame:
    """(name, path): every note in each of its groups; a tagged union of all kinds.

    With ``parity`` a link's alias is part of the target when broken links are looked for.
    """
    path = F.col("path")
    named = lambda kind, v: F.concat(F.lit(f"{kind}:"), v).alias("name")
    folder = F.when(parent(path) == "", F.lit(".")).otherwise(parent(path))
    by_path = vault.notes.select(named("path", folder), "path")
    meta = frontmatter(vault.notes, strict)
    by_tag = meta.select(F.explode("tags").alias("t"), "path").select(named("tag", F.col("t")), "path")
    by_field = meta.select(F.explode("fields").alias("k", "v"), "path").select(F.concat_ws(":", "k", "v").alias("name"), "path")
    d = degrees(vault.notes.select("path"), edges)
    health = d.select(
        F.explode(
            F.array_compact(
                F.array(F.when(F.col("degree") == 0, F.lit("health:orphan")), F.when(F.col("degree") >= HUB_DEGREE, F.lit("health:hub")))
            )
        ).alias("name"),
        "path",
    )
    links = wikilinks(vault)
    links = links.select("src", F.col("body").alias("raw")) if parity else links.where("raw <> ''").select("src", "raw")
    lost = status(links.distinct(), vault).where("status <> 'resolved'")
    broken = lost.select(F.lit("health:broken-link").alias("name"), F.col("src").alias("path"))
    out = by_path
    for part in (by_tag, by_field, health, broken):
        out = out.unionByName(part)
    return out


def suggest(vault: Vault, edges: DataFrame, limit: int | None = 50, theme: str = "default", min_count: int = 1, **kw) -> DataFrame:
    """Groups with their members, largest first."""
    if (limit is not None and limit < 1) or min_count < 1:
        raise ValueError("limit and min_count must be at least 1")
    colors = group_palette(theme)
    member = memberships(vault, edges, **kw).distinct()
    sizes = member.groupBy("name").agg(F.count(F.lit(1)).alias("count")).where(F.col("count") >= min_count)
    if limit is not None:  # only the groups that are shown are gathered
        sizes = sizes.orderBy(F.col("count").desc(), "name").limit(limit)
    paths = F.sort_array(F.collect_list("path")).alias("paths")
    groups = member.join(sizes, "name").groupBy("name").agg(F.max("count").alias("count"), paths)
    kind, value = F.substring_index("name", ":", 1), F.regexp_replace("name", "^[^:]*:", "")
    rows = groups.withColumn("kind", kind).withColumn("value", value)
    k, v = F.col("kind"), F.col("value")
    of = lambda pairs: F.try_element_at(F.create_map(*(F.lit(x) for p in pairs.items() for x in p)), F.when(k == "health", v).otherwise(k))
    field = k.isin("type", "status")
    query = (
        F.when(k == "tag", F.concat(F.lit("tag:#"), v))
        .when(k == "path", F.when(v == ".", F.lit("path:/")).otherwise(F.concat(F.lit("path:"), v)))
        .when(field, F.concat(F.lit("["), k, F.lit(":"), v, F.lit("]")))
        .otherwise(F.lit(""))
    )
    color = F.create_map(*(F.lit(x) for p in colors.items() for x in p))
    out = rows.select(
        "name",
        "kind",
        "value",
        F.col("name").alias("query"),
        query.alias("obsidian_query"),
        F.when(field, F.concat_ws(":", k, v)).alias("property_query"),
        F.coalesce(F.try_element_at(color, k), F.lit(colors["path"])).alias("color"),
        (k == "health").alias("requires_tool"),
        F.when(k == "health", of(COMMANDS)).alias("tool_command"),
        "count",
        "paths",
    )
    return out.orderBy(F.col("count").desc(), "name")


def group_sizes(vault: Vault, edges: DataFrame, **kw) -> DataFrame:
    """(name, count) of all groups, without their members."""
    return memberships(vault, edges, **kw).groupBy("name").agg(F.countDistinct("path").alias("count"))


def has_any_link(notes: DataFrame) -> DataFrame:
    """(path, any_link): whether a note has any wikilink at all."""
    return notes.select("path", F.col("text").rlike(md.WIKI_LINK).alias("any_link"))


__all__ = ["frontmatter", "group_sizes", "has_any_link", "head_block", "memberships", "suggest"]
