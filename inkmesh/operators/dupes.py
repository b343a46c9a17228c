"""Exact and paragraph duplicates, and the review workflow over candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkmesh.functions.text import body, newlines, normal_content, split_lines, strip_ws
from inkmesh.operators.graph import degrees, neighbour_pairs
from inkmesh.session import skew_join


def by_components(paths: Column) -> Column:
    """Paths in order of their components, as a file listing sorts them."""
    keyed = F.transform(paths, lambda p: F.struct(F.split(p, "/").alias("k"), p.alias("p")))
    return F.transform(F.array_sort(keyed), lambda s: s["p"])


def exact_members(notes: DataFrame, include_frontmatter: bool = False) -> DataFrame:
    """(sha256, path, count) of every note with the content of another, one row each.

    The form for any size: groups are counted in parts and never gathered. Without frontmatter
    by default, trailing blanks ignored; with it, texts are compared as they are but for line
    ends. Notes without text are left out.
    """
    text = newlines(F.col("text")) if include_frontmatter else normal_content(F.col("text"))
    keyed = notes.where("text is not null").select(F.sha2(text, 256).alias("sha256"), "path")
    sizes = keyed.groupBy("sha256").agg(F.count(F.lit(1)).alias("count")).where(F.col("count") > 1)
    return skew_join(keyed, sizes.withColumn("_n", F.col("count")), "sha256", "_n", "path")


def exact_duplicates(notes: DataFrame, include_frontmatter: bool = False, limit: int | None = None) -> DataFrame:
    """(sha256, paths, count, method, includes_frontmatter), the report form of exact_members: a row per group."""
    if limit is not None and limit < 1:
        raise ValueError("limit must be at least 1")
    groups = exact_members(notes, include_frontmatter).groupBy("sha256").agg(F.collect_list("path").alias("paths"), F.max("count").alias("count"))
    out = groups.select(
        "sha256",
        by_components(F.col("paths")).alias("paths"),
        "count",
        F.lit("exact").alias("method"),
        F.lit(include_frontmatter).alias("includes_frontmatter"),
    )
    out = out.orderBy(F.col("count").desc(), "paths")
    return out.limit(limit) if limit is not None else out


def paragraphs(notes: DataFrame, parity: bool = False) -> DataFrame:
    """(path, line, text) of paragraphs: runs of lines outside fences that are no heading or quote.

    ``line`` counts from 1 in the text after the head block. With ``parity`` the line that closes
    a fence begins the next paragraph, else it belongs to none.
    """
    each = notes.where("text is not null").select("path", F.posexplode(split_lines(body(newlines(F.col("text"))))).alias("i", "raw"))
    each = each.withColumn("t", strip_ws(F.col("raw")))
    w = Window.partitionBy("path").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    fence = F.col("t").rlike("^(```|~~~)").cast("int")
    each = each.withColumn("fence", fence).withColumn("open", F.sum("fence").over(w) % 2 == 1)
    stop = F.col("open") | (F.col("t") == "") | F.col("t").rlike("^[#>]")
    if not parity:
        stop = stop | (F.col("fence") == 1)
    each = each.withColumn("stop", stop).withColumn("island", F.sum(F.col("stop").cast("int")).over(w)).where(~F.col("stop"))
    each = each.groupBy("path", "island").agg(F.array_sort(F.collect_list(F.struct("i", "raw"))).alias("l"))
    text = strip_ws(F.array_join(F.transform("l", lambda x: x["raw"]), "\n"))
    return each.select("path", (F.element_at("l", 1)["i"] + 1).alias("line"), text.alias("text"))


def paragraph_duplicates(notes: DataFrame, min_chars: int = 40, parity: bool = False) -> DataFrame:
    """(sha256, count, occurrences, method) of paragraphs that stand in several notes."""
    return repeated(paragraphs(notes, parity), min_chars)


def lines(notes: DataFrame) -> DataFrame:
    """(path, line, text) of single lines, for texts that do not part paragraphs."""
    each = notes.where("text is not null").select("path", F.posexplode(split_lines(newlines(F.col("text")))).alias("i", "raw"))
    return each.select("path", (F.col("i") + 1).alias("line"), strip_ws(F.col("raw")).alias("text"))


def repeated_groups(passages: DataFrame, min_chars: int) -> DataFrame:
    """(sha256, count) of passages (path, line, text) that stand in several notes; counted in parts."""
    keyed = passages.where(F.length("text") >= min_chars).select(F.sha2("text", 256).alias("sha256"), "path")
    sizes = keyed.groupBy("sha256").agg(F.count(F.lit(1)).alias("count"), F.min("path").alias("lo"), F.max("path").alias("hi"))
    return sizes.where("lo < hi").select("sha256", "count")


def repeated_places(passages: DataFrame, min_chars: int) -> DataFrame:
    """(sha256, path, line, text, count): a row for every place of a repeated passage."""
    keyed = passages.where(F.length("text") >= min_chars).withColumn("sha256", F.sha2("text", 256))
    sizes = repeated_groups(passages, min_chars)
    return skew_join(keyed, sizes.withColumn("_n", F.col("count")), "sha256", "_n", "path").select("sha256", "path", "line", "text", "count")


def repeated(passages: DataFrame, min_chars: int) -> DataFrame:
    """The report form of repeated_places: a row per passage with its occurrences."""
    places = repeated_places(passages, min_chars)
    groups = places.groupBy("sha256").agg(F.max("count").alias("count"), F.array_sort(F.collect_list(F.struct("path", "line", "text"))).alias("occurrences"))
    out = groups.withColumn("method", F.lit("paragraph-exact"))
    return out.orderBy(F.col("count").desc(), "sha256")


def review(candidates: DataFrame, notes: DataFrame, vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Candidates (left, right, ...) with sizes, digests, degrees and shared neighbours of both sides.

    A candidate that names an unknown note raises.
    """
    facts = (
        notes.select("path", F.octet_length("text").alias("bytes"), F.sha2("text", 256).alias("sha"))
        .join(degrees(vertices, edges), "path")
        .select("path", "bytes", "sha", F.col("in_degree").alias("in"), F.col("out_degree").alias("out"))
    )
    side = lambda s: facts.select(*(F.col(c).alias(s if c == "path" else f"{s}_{c}") for c in facts.columns))
    rows = candidates.join(side("left"), "left", "left").join(side("right"), "right", "left")
    known = F.col("left_sha").isNotNull() & F.col("right_sha").isNotNull()
    lost = F.raise_error(F.concat(F.lit("unknown note in candidate: "), F.col("left"), F.lit(" / "), F.col("right")))
    nbrs = neighbour_pairs(edges)
    both = (
        candidates.select("left", "right")
        .join(nbrs.select(F.col("path").alias("left"), "nbr"), "left")
        .join(nbrs.select(F.col("path").alias("right"), "nbr"), ["right", "nbr"])
        .groupBy("left", "right")
        .agg(F.array_sort(F.collect_set("nbr")).alias("shared_neighbors"))
    )
    none = F.array().cast("array<string>")
    return rows.join(both, ["left", "right"], "left").select(
        *candidates.columns,
        "left_bytes",
        "right_bytes",
        F.when(known, F.col("left_sha")).otherwise(lost.cast("string")).alias("source_sha256"),
        F.col("right_sha").alias("target_sha256"),
        "left_in",
        "left_out",
        "right_in",
        "right_out",
        F.coalesce("shared_neighbors", none).alias("shared_neighbors"),
        F.lit("review").alias("action"),
    )


def redirect_plan(reviewed: DataFrame) -> DataFrame:
    """Plan rows of reviewed candidates whose action is 'redirect'."""
    cols = set(reviewed.columns)
    digest = lambda c: F.col(c) if c in cols else F.lit(None).cast("string")
    return reviewed.where(F.col("action") == "redirect").select(
        F.lit("redirect").alias("operation"),
        F.col("left").alias("source"),
        F.col("right").alias("target"),
        F.lit(True).alias("preserve_alias"),
        F.lit(True).alias("rewrite_inbound_links"),
        F.lit(True).alias("keep_source_file"),
        digest("source_sha256").alias("source_sha256"),
        digest("target_sha256").alias("target_sha256"),
    )


def verify_plan(plan: DataFrame, notes: DataFrame) -> DataFrame:
    """(source, target, ok, errors): whether both files are there, with the planned digests."""
    now = notes.select("path", F.sha2("text", 256).alias("sha"))
    side = lambda s: now.select(F.col("path").alias(s), F.col("sha").alias(f"{s}_now"))
    rows = plan.join(side("source"), "source", "left").join(side("target"), "target", "left")

    def error(s: str) -> Column:
        planned = F.col(f"{s}_sha256") if f"{s}_sha256" in plan.columns else F.lit(None)
        changed = (F.coalesce(planned, F.lit("")) != "") & (planned != F.col(f"{s}_now"))
        return F.when(F.col(f"{s}_now").isNull(), f"{s} missing").when(changed, f"{s} changed")

    errors = F.array_compact(F.array(error("source"), error("target")))
    return rows.select("source", "target", (F.size(errors) == 0).alias("ok"), errors.alias("errors"))
