"""Verification of fragments and redirects, and preflight of migrations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkmesh.functions import markdown as md
from inkmesh.functions.paths import stem
from inkmesh.functions.text import newlines, strip_ws
from inkmesh.operators.links import resolve, status
from inkmesh.session import cut, cut_round
from inkmesh.sources.vault import Vault

# Fixed value: the line that makes a note a redirect.
STUB = r"(?Umd)^>\s+Moved to\s+\[\[([^\]|#]+)(?:#[^\]|]+)?(?:\|[^\]]+)?\]\]\.?\s*$"


def _links(vault: Vault, pattern: str, code: bool) -> DataFrame:
    """(src, raw) of wikilinks, alias cut off."""
    text = F.col("text") if code else md.strip_code(F.col("text"))
    each = vault.notes.select(F.col("path").alias("src"), F.explode(md.wiki_bodies(text, pattern)).alias("body"))
    return each.select("src", strip_ws(F.substring_index("body", "|", 1)).alias("raw"))


def verify_fragments(vault: Vault) -> DataFrame:
    """(file, target, fragment, status, candidates, ok) of wikilinks with a fragment, and of ambiguous ones."""
    links = status(_links(vault, md.ANY_WIKI_LINK, False), vault).withColumn("t", strip_ws(F.substring_index("raw", "#", 1)))
    fragment = F.when(F.contains("raw", F.lit("#")), F.regexp_replace("raw", r"(?s)^[^#]*#", ""))
    links = links.withColumn("fragment", F.when(fragment != "", fragment))
    ambiguous = links.where("status = 'ambiguous'").select(
        F.col("src").alias("file"), F.lit(None).cast("string").alias("target"), "fragment", "status", "candidates", F.lit(False).alias("ok")
    )
    named = resolve(links.where("status <> 'ambiguous' and fragment is not null"), vault, "t").where("target is not null")
    texts = vault.notes.select(F.col("path").alias("target"), "text")
    checked = named.join(texts, "target").select(
        F.col("src").alias("file"),
        "target",
        "fragment",
        F.lit(None).cast("string").alias("status"),
        F.lit(None).cast("array<string>").alias("candidates"),
        md.has_fragment(F.col("text"), F.col("fragment")).alias("ok"),
    )
    return ambiguous.unionByName(checked)


def redirects(vault: Vault) -> DataFrame:
    """(source, raw) of notes with a redirect line; the first counts."""
    line = F.regexp_extract(newlines(F.col("text")), STUB, 1)
    return vault.notes.select(F.col("path").alias("source"), strip_ws(line).alias("raw")).where("raw <> ''")


def verify_redirects(vault: Vault) -> DataFrame:
    """(source, target, status, candidates, final_target, ok) of redirects.

    status: resolved, missing, ambiguous, chain (the target redirects again) or cycle. Chains
    are followed by pointer doubling, so the rounds grow with the logarithm of their length.
    """
    named = status(redirects(vault).withColumnRenamed("source", "src"), vault)
    target = F.when(F.col("status") == "resolved", F.element_at("candidates", 1)).otherwise(F.col("raw"))
    rows = cut(named.select(F.col("src").alias("source"), target.alias("target"), "status", "candidates"))
    hops = rows.select("source", "target")
    # After k rounds ``at`` lies 2**k steps on, or at the end of the chain; who still moves after
    # as many steps as there are redirects is in a cycle or leads into one.
    jump = cut(hops.select("source", F.col("target").alias("at")))
    total, steps = rows.count(), 1
    while steps <= total:
        on = jump.select(F.col("source").alias("at"), F.col("at").alias("next"))
        jump = cut_round(jump.join(on, "at", "left").select("source", F.coalesce("next", "at").alias("at")))
        steps *= 2
    ends = jump.join(hops.select(F.col("source").alias("at"), F.lit(True).alias("moves")), "at", "left")
    out = rows.join(ends.select("source", "at", "moves"), "source")
    chained = rows.select(F.col("source").alias("target"), F.lit(True).alias("again"))
    out = out.join(chained, "target", "left")
    good = F.col("status") == "resolved"
    state = (
        F.when(good & F.col("moves"), "cycle").when(good & F.col("again"), "chain").otherwise(F.col("status"))
    )
    return out.select(
        "source",
        "target",
        state.alias("status"),
        "candidates",
        F.when(state == "chain", F.col("at")).alias("final_target"),
        (state == "resolved").alias("ok"),
    )


def _known(mapping: DataFrame) -> DataFrame:
    """Old names of a mapping (old, new), with and without folder and suffix."""
    old = F.col("old")
    return mapping.select(F.explode(F.array(old, stem(old))).alias("name")).distinct()


def preflight(vault: Vault, mapping: DataFrame) -> DataFrame:
    """(file, raw, status, candidates) of inbound links of moved notes that cannot be rewritten safely."""
    names = _known(mapping)
    links = _links(vault, md.ANY_WIKI_LINK, False).withColumn("base", F.substring_index("raw", "#", 1))
    keyed = links.withColumn("name", F.explode(F.array_distinct(F.array("base", stem(F.col("base"))))))
    hit = keyed.join(names, "name", "left_semi").select("src", "raw").distinct()
    links = _links(vault, md.ANY_WIKI_LINK, False).join(hit, ["src", "raw"], "left_semi")
    bad = status(links, vault).where("status <> 'resolved'").select(F.col("src").alias("file"), "raw", "status", "candidates")
    targets = vault.notes.select(
        F.col("path").alias("file"), F.explode(F.regexp_extract_all(md.strip_code(F.col("text")), F.lit("(?<!!)" + md.PLAIN_MD_LINK), F.lit(2))).alias("raw")
    ).withColumn("raw", strip_ws(F.substring_index("raw", "#", 1)))
    bare = F.explode(F.array_distinct(F.array("raw", F.regexp_replace("raw", r"\.md$", "")))).alias("old")
    moved = targets.where(~F.col("raw").rlike("^(https?://|mailto:)") & F.col("raw").rlike(r"(^|/)\.\.(/|$)"))
    unsafe = moved.select("file", "raw", bare).join(mapping.select("old"), "old", "left_semi").select("file", "raw").distinct()
    unsafe = moved.join(unsafe, ["file", "raw"], "left_semi").select(
        "file", "raw", F.lit("unsafe").alias("status"), F.array().cast("array<string>").alias("candidates")
    )
    return bad.unionByName(unsafe)


def migration_stats(vault: Vault, mapping: DataFrame) -> DataFrame:
    """One row: files and links scanned, rewritable, skipped, ambiguous, with missing fragment."""
    old = mapping.select(F.col("old").alias("name"), F.lit(True).alias("known")).distinct()
    wiki = _links(vault, md.ANY_WIKI_LINK, True).select("src", strip_ws(F.substring_index("raw", "#", 1)).alias("raw"))
    wiki = status(wiki, vault).withColumn("s", stem(F.col("raw")))
    wiki = wiki.join(old.select(F.col("name").alias("raw"), F.col("known").alias("k1")), "raw", "left")
    wiki = wiki.join(old.select(F.col("name").alias("s"), F.col("known").alias("k2")), "s", "left")
    kind = F.when(F.col("status") == "ambiguous", "ambiguous").when(F.col("k1") | F.col("k2"), "rewritable").otherwise("skipped")
    wiki = wiki.select(F.coalesce(kind, F.lit("skipped")).alias("kind"))
    url = F.explode(F.regexp_extract_all(F.col("text"), F.lit("(?<!!)" + md.PLAIN_MD_LINK), F.lit(2))).alias("url")
    plain = vault.notes.select(F.col("path").alias("src"), url).withColumn("raw", strip_ws(F.substring_index("url", "#", 1)))
    plain = plain.where(~F.col("raw").rlike("^(https?://|mailto:|#)") & (F.col("raw") != ""))
    plain = plain.withColumn("fragment", F.when(F.contains("url", F.lit("#")), F.regexp_replace("url", r"(?s)^[^#]*#", "")))
    texts = vault.notes.select(F.col("path").alias("target"), "text")
    plain = resolve(plain, vault).join(texts, "target", "left")
    lost = (F.coalesce("fragment", F.lit("")) != "") & F.col("text").isNotNull() & ~md.has_fragment(F.col("text"), F.col("fragment"))
    plain = plain.withColumn("bare", F.regexp_replace("raw", r"\.md$", ""))
    plain = plain.join(old.select(F.col("name").alias("raw"), F.col("known").alias("k1")), "raw", "left")
    plain = plain.join(old.select(F.col("name").alias("bare"), F.col("known").alias("k2")), "bare", "left")
    kind = F.when(lost, "missing").when(F.coalesce("k1", "k2"), "rewritable").otherwise("skipped")
    both = wiki.unionByName(plain.select(kind.alias("kind")))
    n = lambda *kinds: F.count_if(F.col("kind").isin(*kinds))
    links = both.agg(
        n("ambiguous", "rewritable", "skipped").alias("links_scanned"),
        n("rewritable").alias("links_rewritable"),
        n("skipped").alias("links_skipped"),
        n("ambiguous").alias("ambiguous_links"),
        n("missing").alias("missing_links"),
    )
    files = vault.notes.agg(F.count(F.lit(1)).alias("files_scanned"))
    rows = files.unionByName(links, allowMissingColumns=True)
    return rows.agg(*(F.max(c).alias(c) for c in rows.columns))
