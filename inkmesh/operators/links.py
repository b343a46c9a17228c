"""Link tables: graph edges, resolver status, and the broken-link scan.

Each resolver turns a target into prioritised keys that meet one dictionary of names and paths
in a single equi-join; the best key per link wins in an aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkmesh.functions import markdown as md
from inkmesh.functions.paths import beside, normpath, parent, stem, top_dir
from inkmesh.functions.text import strip_ws
from inkmesh.sources.vault import Vault


def _name(c: Column) -> Column:
    return F.concat(F.lit("n:"), c)


def _path(c: Column) -> Column:
    return F.concat(F.lit("p:"), c)


def note_keys(vault: Vault) -> DataFrame:
    """(key, target) of notes: by stem the last path, by path itself."""
    by_name = vault.notes.groupBy(_name(stem(F.col("path"))).alias("key")).agg(F.max("path").alias("target"))
    return by_name.unionByName(vault.notes.select(_path(F.col("path")).alias("key"), F.col("path").alias("target")))


def resolve(links: DataFrame, vault: Vault, raw: str = "raw", src: str = "src") -> DataFrame:
    """Add ``target`` to links: the note a raw wikilink target means for the graph, or null.

    Order: the stem's last path (every '.md' taken out), the path, the path with '.md', both
    beside the source. Links are resolved once per distinct (src, raw).
    """
    t, folder = F.col(raw), parent(F.col(src))
    dotted = F.concat(t, F.lit(".md"))
    tried = F.transform(F.array(t, dotted, beside(folder, t), beside(folder, dotted)), lambda p: _path(normpath(p)))
    keys = F.concat(F.array(_name(F.replace(t, F.lit(".md"), F.lit("")))), tried)
    each = links.select(src, raw).where(t.isNotNull() & F.col(src).isNotNull()).distinct()
    each = each.select(src, raw, F.posexplode(keys).alias("rank", "key"))
    best = each.join(note_keys(vault), "key").groupBy(src, raw).agg(F.min_by("target", "rank").alias("target"))
    return links.join(best, [src, raw], "left")


def wikilinks(vault: Vault) -> DataFrame:
    """(src, body, raw) of all wikilinks, code included."""
    each = vault.notes.select(F.col("path").alias("src"), F.explode(md.wiki_bodies(F.col("text"))).alias("body"))
    return each.withColumn("raw", md.graph_target(F.col("body")))


def edges(vault: Vault) -> DataFrame:
    """Distinct (src, dst) of resolved wikilinks between different notes."""
    links = wikilinks(vault).where("raw <> ''").select("src", "raw").distinct()
    return resolve(links, vault).where("target <> src").select("src", F.col("target").alias("dst")).distinct()


def status(links: DataFrame, vault: Vault, raw: str = "raw", src: str = "src") -> DataFrame:
    """Add ``status`` (resolved, ambiguous, missing) and ``candidates`` to wikilink targets."""
    t = strip_ws(F.substring_index(F.col(raw), "#", 1))
    work = links.withColumn("_t", t).withColumn("_stem", stem(t))
    # The flag comes from the count: where no one asks for candidates, none are gathered.
    many = vault.stems.where("n > 1").select(F.col("stem").alias("_stem"), F.col("candidates").alias("_many"), F.col("n").alias("_n"))
    work = resolve(work, vault, "_t", src).join(many, "_stem", "left")
    ambiguous = F.col("_n").isNotNull() & ~F.contains(F.col("_t"), F.lit("/"))
    found = F.col("target").isNotNull()
    state = F.when(ambiguous, "ambiguous").when(found, "resolved").otherwise("missing")
    none = F.array().cast("array<string>")
    cands = F.when(ambiguous, F.col("_many")).when(found, F.array("target")).otherwise(none)
    return work.withColumn("status", state).withColumn("candidates", cands).drop("_t", "_stem", "_many", "_n", "target")


def scan_tokens(vault: Vault, exclude: tuple[str, ...] | None = None) -> DataFrame:
    """(id, src, kind, shown, target, class) of every link token outside code.

    class: anchor, external, placeholder, site_path, html_doc, or path for what must exist.
    ``shown`` is what a report prints.
    """
    text = vault.scanned(exclude).select(F.col("path").alias("src"), md.strip_code(F.col("text")).alias("t"))
    as_rows = lambda kind, shown: F.transform(shown, lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("shown")))
    both = F.concat(
        as_rows("markdown", F.transform(md.md_targets(F.col("t")), strip_ws)),
        as_rows("wikilink", F.transform(md.wiki_bodies(F.col("t")), md.scan_target)),
    )
    # Targets and classes are made before the rows are: filters on them then stay short.
    known = _classified(F.col("src"), both)
    return text.select("src", F.posexplode(known).alias("pos", "x")).select("src", "pos", "x.*")


def _classified(src: Column, tokens: Column) -> Column:
    """Add target and class to an array of (kind, shown)."""
    aimed = F.transform(tokens, lambda x: F.struct(x["kind"].alias("kind"), x["shown"].alias("shown"), md.clean_target(x["shown"]).alias("target")))
    kind = lambda x: _link_class(src, x["kind"], x["target"])
    return F.transform(aimed, lambda x: x.withField("class", kind(x)))


def _link_class(src: Column, kind: Column, t: Column) -> Column:
    markdown = kind == "markdown"
    return (
        F.when((t == "") | t.startswith("#"), "anchor")
        .when(F.lower(t).rlike(md.SCHEME), "external")
        .when(t.rlike(md.PLACEHOLDER), "placeholder")
        .when(markdown & md.is_site_path(src, t), "site_path")
        .when(markdown & md.is_html_mirror(src, t), "html_doc")
        .otherwise("path")
    )


def _existing(tokens: DataFrame, vault: Vault) -> DataFrame:
    """Distinct (src, kind, target) of path-like targets that exist."""
    t, folder = F.ltrim(F.col("target"), F.lit("/")), parent(F.col("src"))
    tried = F.array_compact(F.array(F.when(~t.rlike(r"^\.\.?/"), t), beside(folder, t)))
    ends = lambda p: F.array(F.lit(""), *(F.when(~p.endswith(".md"), F.lit(x)) for x in (".md", "/README.md", "/index.md")))
    more = lambda p: F.transform(F.array_compact(ends(p)), lambda x: _path(F.concat(p, x)))
    named = F.when(F.col("kind") == "wikilink", F.array(_name(stem(t)))).otherwise(F.array().cast("array<string>"))
    keys = F.concat(F.flatten(F.transform(F.transform(tried, normpath), more)), named)
    known = vault.files.select(_path(F.col("path")).alias("key")).unionByName(vault.dirs.select(_path(F.col("dir")).alias("key")))
    known = known.unionByName(vault.notes.select(_name(stem(F.col("path"))).alias("key"))).distinct()
    each = tokens.select("src", "kind", "target").distinct().select("src", "kind", "target", F.explode(keys).alias("key"))
    return each.join(known, "key", "left_semi").select("src", "kind", "target").distinct()


def broken_links(vault: Vault, exclude: tuple[str, ...] | None = None, tokens: DataFrame | None = None) -> DataFrame:
    """(src, pos, kind, target) of link tokens whose target does not exist; repeats are kept."""
    tokens = scan_tokens(vault, exclude) if tokens is None else tokens
    paths = tokens.where(F.col("class") == "path")
    lost = paths.join(_existing(paths, vault), ["src", "kind", "target"], "left_anti")
    # A wikilink may escape its alias pipe, as tables need it: the part before the pipe counts too.
    alt = F.when((F.col("kind") == "wikilink") & F.contains(F.col("shown"), F.lit("|")), strip_ws(F.substring_index("shown", "|", 1)))
    again = F.array(F.struct(F.col("kind"), alt.alias("shown")))
    retry = lost.where(alt.isNotNull()).select("src", "pos", F.explode(_classified(F.col("src"), again)).alias("x")).select("src", "pos", "x.*")
    found = retry.join(_existing(retry, vault), ["src", "kind", "target"], "left_semi").unionByName(retry.where("class <> 'path'"))
    saved = found.select("src", "pos").distinct()
    return lost.join(saved, ["src", "pos"], "left_anti").select("src", "pos", "kind", F.col("shown").alias("target"))


def scan_summary(vault: Vault, exclude: tuple[str, ...] | None = None) -> DataFrame:
    """One row of totals: files, tokens, broken and ignored links, priority files."""
    tokens = scan_tokens(vault, exclude)
    lost = broken_links(vault, exclude, tokens)
    counts = tokens.agg(
        F.count(F.lit(1)).alias("tokens"),
        *(F.count_if(F.col("class") == c).alias(f"{c}_ignored") for c in ("external", "placeholder", "html_doc", "site_path")),
    )
    src = F.col("src")
    urgent = src.isin("index.md", "30-reference/README.md") | src.startswith("20-areas/") | src.startswith("40-notes/")
    totals = lost.agg(
        F.count(F.lit(1)).alias("broken_total"),
        F.countDistinct("src").alias("broken_files"),
        F.countDistinct(F.when(urgent, src)).alias("priority_files"),
    )
    files = vault.scanned(exclude).agg(F.count(F.lit(1)).alias("scan_files"))
    rows = files.unionByName(counts, allowMissingColumns=True).unionByName(totals, allowMissingColumns=True)
    return rows.agg(*(F.max(c).alias(c) for c in rows.columns))


def broken_by_dir(vault: Vault, exclude: tuple[str, ...] | None = None, under: str | None = None) -> DataFrame:
    """Broken links per top folder, or per second-level folder below ``under``."""
    lost = broken_links(vault, exclude)
    if under:
        lost = lost.where(F.col("src").startswith(under))
        key = F.substring_index("src", "/", 2)
    else:
        key = top_dir(F.col("src"), F.col("src"))
    return lost.groupBy(key.alias("dir")).agg(F.count(F.lit(1)).alias("broken"), F.min("src").alias("first_src"))


def top_dirs(broken: DataFrame, under: str | None = None, n: int | None = 10) -> DataFrame:
    """(dir, broken) of the first folders by broken links (src), or of second-level ones below ``under``; ties by path."""
    rows = broken.where(F.col("src").startswith(under)) if under else broken
    key = F.substring_index("src", "/", 2) if under else top_dir(F.col("src"), F.col("src"))
    counts = rows.groupBy(key.alias("dir")).agg(F.count(F.lit(1)).alias("broken"), F.min("src").alias("first"))
    out = counts.orderBy(F.col("broken").desc(), "first").select("dir", "broken")
    return out.limit(n) if n is not None else out


def broken_by_file(vault: Vault, exclude: tuple[str, ...] | None = None) -> DataFrame:
    return broken_links(vault, exclude).groupBy("src").agg(F.count(F.lit(1)).alias("broken"))


def unresolved(vault: Vault, strict: bool = False) -> DataFrame:
    """Wanted pages: (target, references) of wikilink targets without a note.

    ``strict`` counts graph edges only; as these end at notes, nothing is ever wanted then.
    """
    links = wikilinks(vault).where("raw <> ''")
    lost = resolve(links, vault).where("target is null")
    if strict:
        lost = lost.limit(0)
    return lost.groupBy(F.col("raw").alias("target")).agg(F.count(F.lit(1)).alias("references"))
