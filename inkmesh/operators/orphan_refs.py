"""References to records that do not exist (problem 3).

Parents are (key, lifetime) records. Their lifetimes are sets of integer instants; sorted, these
are compressed into contiguous runs [start, end) per key. A reference (key, instant) is matched
as of its instant to the preceding run start, and is an orphan beyond that run's end. Both sides
carry a time bucket, so a key that holds a large part of all references is spread over buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkmesh.functions.paths import basename, beside, normpath, parent
from inkmesh.functions.text import micros, percent_decode, strip_ws

#: Buckets of 2**43 microseconds, about 102 days.
BUCKET_BITS = 43
#: Slices of 2**37 microseconds, about 38 hours, in which the lifetimes of one key are joined first.
SLICE_BITS = 37
#: Kinds of key: whole path, path with an optional suffix, name with an optional suffix.
EXACT, PATH, NAME = 0, 1, 2
SCHEME = r"^[A-Za-z][A-Za-z0-9+.\-]*:"


def link_target(kind: Column, raw: Column) -> Column:
    """The path a raw link target names; null when it is no reference."""
    t = strip_ws(raw)
    wiki = F.when(F.contains(t, F.lit("|")), F.regexp_replace(t, r"(?s)\\?\|.*$", "")).otherwise(t)
    quoted = t.endswith('"') | t.endswith("'")
    plain = F.when(quoted, strip_ws(F.regexp_replace(t, r"""(?U)\s+("[^"]*"|'[^']*')$""", ""))).otherwise(t)
    enclosed = plain.startswith("<") & plain.endswith(">")
    plain = percent_decode(F.when(enclosed, F.substring(plain, F.lit(2), F.length(plain) - 2)).otherwise(plain))
    t = F.when(kind == "wikilink", wiki).when(kind == "markdown", plain).otherwise(t)
    t = strip_ws(F.ltrim(strip_ws(F.substring_index(t, "#", 1)), F.lit("!")))
    return F.when((t != "") & ~(F.contains(t, F.lit(":")) & t.rlike(SCHEME)), t)


def parent_keys(parents: DataFrame) -> DataFrame:
    """(kind, key, start, end, source) of parents (path, start, end, source); null end: still there."""
    path, name = F.col("path"), basename(F.col("path"))

    def with_alias(kind: int, x: Column) -> list[Column]:
        own = F.struct(F.lit(kind).alias("kind"), x.alias("key"))
        bare = F.when(x.endswith(".md"), F.struct(F.lit(kind).alias("kind"), F.regexp_replace(x, r"\.md$", "").alias("key")))
        return [own, bare]

    keys = F.array(F.struct(F.lit(EXACT).alias("kind"), path.alias("key")), *with_alias(PATH, path), *with_alias(NAME, name))
    return (
        parents.where(path.isNotNull() & F.col("start").isNotNull())
        .withColumn("k", F.explode(F.array_compact(keys)))
        .select("k.kind", "k.key", "start", "end", "source")
    )


def _merge(acc: Column, x: Column) -> Column:
    last = F.element_at(acc, -1)
    grown = F.struct(last["s"].alias("s"), F.greatest(last["e"], x["e"]).alias("e"))
    joins = (F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["e"] >= x["s"])
    return F.when(joins, F.array_append(F.slice(acc, F.lit(1), F.size(acc) - 1), grown)).otherwise(F.array_append(acc, x))


def runs(keys: DataFrame, first: Column, last: Column) -> DataFrame:
    """Contiguous runs per (kind, key, bucket), clipped to [first, last] as sorted arrays.

    Equal lifetimes, as those that fill a bucket, are one before anything is shuffled. Runs are
    joined within slices of a bucket first, by one pass over sorted rows, so that a name that many
    parents share is neither one task nor one array; an array has the runs that are left of them.
    """
    low, high = F.greatest(F.col("start"), first), F.least(F.coalesce(F.col("end"), last + 1), last + 1)
    width = F.lit(1 << BUCKET_BITS)
    parts = (
        keys.select("kind", "key", low.alias("s"), high.alias("e"))
        .where("s < e")
        .withColumn("bucket", F.explode(F.sequence(F.shiftright("s", BUCKET_BITS), F.shiftright(F.col("e") - 1, BUCKET_BITS))))
        .withColumn("b0", F.col("bucket").cast("bigint") * width)
        .select("kind", "key", "bucket", F.greatest("s", F.col("b0")).alias("s"), F.least(F.col("e"), F.col("b0") + width).alias("e"))
        .groupBy("kind", "key", "bucket", F.shiftright("s", SLICE_BITS).alias("slice"), "s")
        .agg(F.max("e").alias("e"))
    )
    w = Window.partitionBy("kind", "key", "bucket", "slice").orderBy("s")
    before = F.max("e").over(w.rowsBetween(Window.unboundedPreceding, -1))
    apart = parts.withColumn("new", (before.isNull() | (before < F.col("s"))).cast("int")).withColumn("island", F.sum("new").over(w))
    joined = apart.groupBy("kind", "key", "bucket", "slice", "island").agg(F.min("s").alias("s"), F.max("e").alias("e"))
    empty = F.array().cast("array<struct<s:bigint,e:bigint>>")
    return joined.groupBy("kind", "key", "bucket").agg(
        F.aggregate(F.array_sort(F.collect_list(F.struct("s", "e"))), empty, _merge).alias("runs")
    )


def dangling(refs: DataFrame, keys: DataFrame, instants: DataFrame) -> DataFrame:
    """(link_id, row, slot, at) of references none of whose keys lives at ``at``.

    refs: link_id, row, slot, at (microseconds), kind, key; rows that agree in the first three are
    alternatives of one reference. A null key never lives. Repeated rows count once; two
    references of one link_id and slot that differ do not hide each other, and dangle if one
    does. ``instants`` holds every ``at`` (more does no harm); only its extremes are used, to
    clip lifetimes. A key that very many references hold is spread over its buckets, and within
    one by the adaptive split of skewed joins.
    """
    span = instants.agg(F.min("at").alias("lo"), F.max("at").alias("hi")).first()
    if span["lo"] is None:
        return refs.select("link_id", "row", "slot", "at").limit(0)
    table = runs(keys, F.lit(span["lo"]), F.lit(span["hi"]))
    probe = refs.withColumn("bucket", F.shiftright("at", BUCKET_BITS))
    before = F.filter("runs", lambda r: r["s"] <= F.col("at"))
    lives = F.coalesce(F.try_element_at(before, F.lit(-1))["e"] > F.col("at"), F.lit(False))
    return (
        probe.join(table, ["kind", "key", "bucket"], "left")
        .groupBy("link_id", "row", "slot")
        .agg(F.max(lives).alias("lives"), F.max("at").alias("at"))
        .where(~F.col("lives"))
        .drop("lives")
    )


def lifetimes(notes: DataFrame, files: DataFrame) -> DataFrame:
    """Lifetimes of notes and shared files, distinct: a row may be delivered twice."""
    a = notes.select("path", micros(F.col("created_at")).alias("start"), micros(F.col("deleted_at")).alias("end"), F.lit("notes").alias("source"))
    b = files.select("path", micros(F.col("added_at")).alias("start"), micros(F.col("deleted_at")).alias("end"), F.lit("shared_files").alias("source"))
    return a.unionByName(b)


def link_refs(links: DataFrame) -> DataFrame:
    """References of links: slot 0 the raw target with its alternatives, slot i a candidate.

    A raw target with a leading '/' starts at the root and is not looked for beside ``src``.
    ``row`` tells apart unequal rows that share a link_id.
    """
    t, src = F.col("t"), F.col("src")

    def key(kind: int, x: Column) -> Column:
        return F.struct(F.lit(0).alias("slot"), F.lit(kind).alias("kind"), x.alias("key"))

    own = F.array_compact(
        F.array(
            F.when(t.isNotNull(), key(PATH, F.col("root"))),
            F.when(~F.col("rooted") & (F.col("near") != F.col("root")), key(PATH, F.col("near"))),
            F.when((F.col("kind") == "wikilink") & ~F.contains(t, F.lit("/")), key(NAME, t)),
        )
    )
    cands = F.transform(
        "candidates", lambda x, i: F.when(x.isNotNull(), F.struct((i + 1).alias("slot"), F.lit(EXACT).alias("kind"), x.alias("key")))
    )
    every = F.when(F.col("candidates").isNull(), own).otherwise(F.concat(own, F.array_compact(cands)))
    # One step for each column that the next uses more than once: none is computed twice.
    rows = links.where("seen_at is not null").select(
        "link_id",
        F.hash("src", "kind", "raw", "candidates", "seen_at").alias("row"),
        "src",
        "kind",
        "candidates",
        micros(F.col("seen_at")).alias("at"),
        link_target(F.col("kind"), F.col("raw")).alias("t"),
    )
    rows = rows.withColumn("rel", F.ltrim(t, F.lit("/"))).withColumn("rooted", t.startswith("/"))
    rows = rows.withColumn("near", F.when(src.isNotNull(), beside(parent(src), F.col("rel"))))
    rows = rows.withColumn("root", normpath(F.col("rel"))).withColumn("near", normpath(F.col("near")))
    return rows.select("link_id", "row", "at", F.explode(every).alias("k")).select("link_id", "row", "at", "k.slot", "k.kind", "k.key")


def dangling_links(links: DataFrame, notes: DataFrame, files: DataFrame) -> DataFrame:
    """Dangling references of ``links`` (link_id, slot, at).

    Null or blank raw targets, outside links and null candidates are no references; links
    without ``seen_at`` have no instant and are left out; empty tables give empty results, and
    with no parents every reference dangles. Other columns of the inputs are ignored.
    """
    instants = links.select(micros(F.col("seen_at")).alias("at"))
    lost = dangling(link_refs(links), parent_keys(lifetimes(notes, files)), instants)
    return lost.groupBy("link_id", "slot").agg(F.max("at").alias("at"))


def dangling_report(links: DataFrame, notes: DataFrame, files: DataFrame) -> DataFrame:
    """Dangling references per referenced table and month.

    The table is the one that holds the key at some other time ('notes' before 'shared_files'),
    'none' when no table ever held it.
    """
    refs, keys = link_refs(links), parent_keys(lifetimes(notes, files))
    lost = dangling(refs, keys, links.select(micros(F.col("seen_at")).alias("at")))
    ever = keys.groupBy("kind", "key").agg(F.min("source").alias("source"))
    named = (
        refs.join(lost.drop("at"), ["link_id", "row", "slot"], "left_semi")
        .join(ever, ["kind", "key"], "left")
        .groupBy("link_id", "slot")
        .agg(F.min("source").alias("source"), F.max("at").alias("at"))
    )
    month = F.date_format(F.date_from_unix_date(F.floor(F.col("at") / 86_400_000_000).cast("int")), "yyyy-MM")
    return (
        named.groupBy(F.coalesce("source", F.lit("none")).alias("referenced"), month.alias("month"))
        .agg(F.count(F.lit(1)).alias("dangling"), F.countDistinct("link_id").alias("links"))
    )
