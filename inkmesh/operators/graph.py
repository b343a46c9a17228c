"""Graph operators over vertices (path) and edges (src, dst)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkmesh.functions.paths import top_dir
from inkmesh.operators.blocks import meet
from inkmesh.session import cut, cut_round

DIRECTIONS = ("both", "outgoing", "incoming")
#: Parts of a class that are cut to its first members separately.
PARTS = 64


def both_ways(edges: DataFrame) -> DataFrame:
    """(path, nbr, relation): every edge from both of its ends."""
    out = edges.select(F.col("src").alias("path"), F.col("dst").alias("nbr"), F.lit("outgoing").alias("relation"))
    back = edges.select(F.col("dst").alias("path"), F.col("src").alias("nbr"), F.lit("backlink").alias("relation"))
    return out.unionByName(back)


def neighbour_pairs(edges: DataFrame) -> DataFrame:
    """Distinct (path, nbr), direction forgotten."""
    return both_ways(edges).select("path", "nbr").distinct()


def degrees(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(path, in_degree, out_degree, degree) of every vertex."""
    ends = both_ways(edges).groupBy("path").agg(
        F.count_if(F.col("relation") == "backlink").alias("i"), F.count_if(F.col("relation") == "outgoing").alias("o")
    )
    n = lambda c: F.coalesce(c, F.lit(0)).cast("bigint")
    return vertices.select("path").join(ends, "path", "left").select(
        "path", n("i").alias("in_degree"), n("o").alias("out_degree"), (n("i") + n("o")).alias("degree")
    )


def hubs(vertices: DataFrame, edges: DataFrame, top_n: int = 20) -> DataFrame:
    return degrees(vertices, edges).orderBy(F.col("degree").desc(), "path").limit(top_n)


def islands(vertices: DataFrame, edges: DataFrame, min_links: int = 0) -> DataFrame:
    return degrees(vertices, edges).where(F.col("degree") <= min_links).select("path", "degree").orderBy("degree", "path")


def orphan_classes(vertices: DataFrame, edges: DataFrame, linked: DataFrame) -> DataFrame:
    """(path, class, zero) of every note: connected, only_outgoing, only_incoming, zero_both.

    ``linked`` (path, any_link) tells notes of the last class with unresolved links ('broken')
    from those without any ('none').
    """
    d = degrees(vertices, edges).join(linked, "path", "left")
    i, o = F.col("in_degree") > 0, F.col("out_degree") > 0
    kind = F.when(i & o, "connected").when(o, "only_outgoing").when(i, "only_incoming").otherwise("zero_both")
    zero = F.when(~i & ~o, F.when(F.coalesce("any_link", F.lit(False)), "broken").otherwise("none"))
    return d.select("path", kind.alias("class"), zero.alias("zero"))


def orphan_summary(classes: DataFrame) -> DataFrame:
    """(class, notes, percent of all, one decimal)."""
    total = classes.groupBy("class").agg(F.count(F.lit(1)).alias("notes"))
    every = F.sum("notes").over(Window.partitionBy(F.lit(0)))  # a window over at most four rows
    return total.withColumn("percent", F.round(F.lit(100.0) * F.col("notes") / every, 1))


def orphan_dirs(classes: DataFrame) -> DataFrame:
    """Per top folder: unlinked notes, those without any link, those with broken ones."""
    zero = classes.where(F.col("class") == "zero_both")
    return zero.groupBy(top_dir(F.col("path"), F.lit(".")).alias("dir")).agg(
        F.count(F.lit(1)).alias("zero_both"), F.count_if(F.col("zero") == "none").alias("none"), F.count_if(F.col("zero") == "broken").alias("broken")
    )


def orphan_notes(classes: DataFrame, limit: int | None = None) -> DataFrame:
    """(path, zero) of unlinked notes in order of their paths."""
    out = classes.where(F.col("class") == "zero_both").select("path", "zero").orderBy("path")
    return out.limit(limit) if limit is not None else out


def link_stats(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: notes, notes with outgoing links, edges."""
    d = degrees(vertices, edges)
    return d.agg(
        F.count(F.lit(1)).alias("notes"), F.count_if(F.col("out_degree") > 0).alias("linked_notes"), F.sum("out_degree").alias("edges")
    )


def neighbors(
    vertices: DataFrame, edges: DataFrame, anchors: list[str], depth: int = 1, direction: str = "both", limit: int | None = None
) -> DataFrame:
    """(path, hop, relation) of what anchors reach in ``depth`` hops, nearest first.

    Unknown anchors are ignored. A note has the relation by which the first queued parent
    reached it: parents in order of discovery, children by (path, relation). One join and one
    aggregation per hop; the frontier is checkpointed so the plan does not grow.
    """
    if depth < 0:
        raise ValueError("depth must not be negative")
    if direction not in DIRECTIONS:
        raise ValueError(f"direction must be one of {DIRECTIONS}")
    spark = edges.sparkSession
    ordered = list(dict.fromkeys(anchors))
    start = spark.createDataFrame([(a, i) for i, a in enumerate(ordered)], "path string, rank bigint")
    start = start.join(vertices.select("path"), "path", "left_semi")
    seen = start.select("path", F.lit(0).alias("hop"), F.lit("anchor").alias("relation"), "rank")
    steps = both_ways(edges)
    if direction != "both":
        steps = steps.where(F.col("relation") == ("outgoing" if direction == "outgoing" else "backlink"))
    steps, front = cut(steps), cut(seen)
    seen = front
    for hop in range(1, depth + 1):
        reached = (
            front.select("path", "rank")
            .join(steps, "path")
            .groupBy("nbr")
            .agg(F.min(F.struct("rank", "nbr", "relation")).alias("first"))
            .join(seen.select(F.col("path").alias("nbr")), "nbr", "left_anti")
        )
        # Ranks only order the frontier; a range partitioned sort gives them without one task for all.
        first = _ranked(reached.select("nbr", F.col("first.rank").alias("parent"), F.col("first.relation").alias("relation")), ["parent", "nbr", "relation"])
        front = cut_round(first.select(F.col("nbr").alias("path"), F.lit(hop).alias("hop"), "relation", "rank"))
        if front.isEmpty():
            break
        seen = cut_round(seen.unionByName(front))
    out = seen.select("path", "hop", "relation").orderBy("hop", "path")
    return out.limit(limit) if limit is not None else out


def _ranked(df: DataFrame, by: list[str]) -> DataFrame:
    """Add ``rank``: increasing with the order of ``by`` (with gaps)."""
    return df.orderBy(*by).withColumn("rank", F.monotonically_increasing_id())


def context(vertices: DataFrame, edges: DataFrame, anchors: str | list[str], depth: int = 1, limit: int | None = 50) -> DataFrame:
    """Neighbours both ways of one or several anchors."""
    return neighbors(vertices, edges, [anchors] if isinstance(anchors, str) else anchors, depth, "both", limit)


def expand(vertices: DataFrame, edges: DataFrame, results: DataFrame, depth: int = 1, direction: str = "both", limit: int | None = 50) -> DataFrame:
    """Search results with their graph neighbours.

    results: path, score and any other fields, which input rows keep; ``source`` is 'input'
    unless given, 'graph' for rows the graph adds; rows outside the graph vanish. Of several
    results with one path the last counts. The results are a query's hits: their paths are the
    anchors, named on the driver.
    """
    last = results.withColumn("_at", F.monotonically_increasing_id()).groupBy("path").agg(F.max_by(F.struct(*results.columns), "_at").alias("r"))
    given = last.select("r.*").join(vertices.select("path"), "path", "left_semi")
    anchors = [r["path"] for r in given.select("path").collect()]
    near = neighbors(vertices, edges, sorted(anchors), depth, direction)
    score = F.col("score").cast("double") if "score" in given.columns else F.lit(None).cast("double")
    keep = given.withColumn("anchor_score", score)
    keep = keep.withColumn("source", F.coalesce("source", F.lit("input")) if "source" in keep.columns else F.lit("input"))
    keep = keep.drop("hop", "relation")
    out = near.join(keep, "path", "left").withColumn("source", F.coalesce("source", F.lit("graph")))
    out = out.orderBy("hop", F.coalesce("anchor_score", F.lit(0.0)).desc(), "path")
    return out.limit(limit) if limit is not None else out


def similar(vertices: DataFrame, edges: DataFrame, node: str, top_n: int = 10) -> DataFrame:
    """(path, score, method, semantic): notes by Jaccard of neighbours with ``node``, zeros included."""
    nbrs = neighbour_pairs(edges)
    sizes = nbrs.groupBy("path").agg(F.count(F.lit(1)).alias("n"))
    mine = nbrs.where(F.col("path") == node).select("nbr", F.lit(1).alias("one"))
    shared = nbrs.join(mine, "nbr").groupBy("path").agg(F.count(F.lit(1)).alias("shared"))
    own = mine.agg(F.count(F.lit(1)).alias("own"), F.lit(node).alias("_node"))
    known = vertices.where(F.col("path") == node).select(F.lit(node).alias("_node"))
    others = vertices.where(F.col("path") != node).select("path", F.lit(node).alias("_node")).join(F.broadcast(known.join(own, "_node")), "_node")
    n, i = F.coalesce("n", F.lit(0)), F.coalesce("shared", F.lit(0))
    union = n + F.col("own") - i
    score = F.when(union > 0, i / union).otherwise(F.lit(0.0))
    full = others.join(sizes, "path", "left").join(shared, "path", "left")
    out = full.select("path", F.round(score, 6).alias("score"), F.lit("jaccard").alias("method"), F.lit(False).alias("semantic"))
    return out.orderBy(F.col("score").desc(), "path").limit(top_n)


def similar_to(vertices: DataFrame, edges: DataFrame, queries: DataFrame, top_n: int = 10) -> DataFrame:
    """(query, path, score): ``similar`` for many query notes (path) at once, against all notes.

    Unknown queries have no rows; ties are in order of path, and where fewer than top_n notes share
    a neighbour, the first others follow with 0, as they do for one note.
    """
    nbrs = neighbour_pairs(edges)
    sizes = nbrs.groupBy("path").agg(F.count(F.lit(1)).alias("n"))
    known = queries.select(F.col("path").alias("query")).distinct().join(vertices.select(F.col("path").alias("query")), "query", "left_semi")
    known = known.join(sizes.select(F.col("path").alias("query"), F.col("n").alias("own")), "query", "left")
    asked = nbrs.select(F.col("path").alias("query"), "nbr").join(known, "query")
    shared = asked.join(nbrs, "nbr").where("query <> path").groupBy("query", "path").agg(F.count(F.lit(1)).alias("i"), F.first("own").alias("own"))
    score = F.round(F.col("i") / (F.col("n") + F.col("own") - F.col("i")), 6)
    near = shared.join(sizes, "path").select("query", "path", score.alias("score"))
    # With the first 2 * top_n + 1 notes every query can be filled up, whatever it shares with them.
    first = F.broadcast(vertices.select("path").orderBy("path").limit(2 * top_n + 1))
    fill = known.select("query").join(first, F.col("query") != F.col("path")).select("query", "path", F.lit(0.0).alias("score"))
    rows = near.unionByName(fill).groupBy("query", "path").agg(F.max("score").alias("score"))
    part = F.pmod(F.xxhash64("path"), F.lit(PARTS))
    for w in (Window.partitionBy("query", part), Window.partitionBy("query")):
        rows = rows.withColumn("r", F.row_number().over(w.orderBy(F.col("score").desc(), "path"))).where(F.col("r") <= top_n).drop("r")
    return rows


def structural_classes(edges: DataFrame, threshold: float = 0.25) -> tuple[DataFrame, DataFrame]:
    """(links: a, b, shared, union_size), (members: path, rep, n, members) of notes with common neighbours.

    Notes with the same neighbours are one class, known by sums of hashes, so that a hub's
    followers are not paired among themselves. Classes meet in the rarest of their neighbours
    only: two sets above the threshold share one of their n - ceil(threshold * n) + 1 rarest, and
    a hub is the last of them, among the rarest of small sets only. a < b are the first notes of all classes above the threshold.
    """
    if not 0 <= threshold <= 1:
        raise ValueError("threshold must lie between 0 and 1")
    nbrs = neighbour_pairs(edges)
    h = F.xxhash64("nbr")
    sums = (F.count(F.lit(1)).alias("n"), F.bit_xor(h).alias("x"), F.sum(h.bitwiseAND(F.lit((1 << 40) - 1))).alias("s"))
    keyed = nbrs.groupBy("path").agg(*sums)
    classes = keyed.groupBy("n", "x", "s").agg(F.min("path").alias("rep"), F.count(F.lit(1)).alias("members"))
    member = cut(keyed.join(classes, ["n", "x", "s"]).select("path", "rep", "n", "members"))
    reps = member.where(F.col("path") == F.col("rep")).select("rep", "n")
    tokens = cut(nbrs.join(reps, nbrs["path"] == reps["rep"]).select("rep", "nbr", "n"))
    df = tokens.groupBy("nbr").agg(F.count(F.lit(1)).alias("df"))
    rank = F.row_number().over(Window.partitionBy("rep").orderBy("df", "nbr"))
    head = tokens.join(df, "nbr").withColumn("r", rank)
    head = head.where((F.col("r") <= F.col("n") - F.ceil(F.col("n") * F.lit(threshold) - 1e-9) + 1) & (F.col("df") > 1))
    # Sets that share a hub and little else can be similar too, so a hub's classes meet by blocks.
    ratio = F.least("a_n", "b_n") >= F.greatest("a_n", "b_n") * F.lit(threshold) - 1e-9
    met = meet(head, "nbr", "df", "rep", ["n"], ratio)
    met = met.select(F.col("a_rep").alias("a"), F.col("b_rep").alias("b"), F.col("a_n").alias("na"), F.col("b_n").alias("nb")).distinct()
    ta, tb = tokens.select(F.col("rep").alias("a"), "nbr"), tokens.select(F.col("rep").alias("b"), "nbr")
    i = met.join(ta, "a").join(tb, ["b", "nbr"]).groupBy("a", "b").agg(F.count(F.lit(1)).alias("i"), F.first("na").alias("na"), F.first("nb").alias("nb"))
    union = F.col("na") + F.col("nb") - F.col("i")
    across = i.where(F.col("i") / union >= threshold).select("a", "b", F.col("i").alias("shared"), union.alias("union_size"))
    return across, member


def structural_links(edges: DataFrame, threshold: float = 0.25) -> DataFrame:
    """structural_pairs without a limit, by classes: (left, right, score, shared, union_size, method, semantic, same_class).

    A row of two classes stands for all pairs of their notes and names their first ones; rows of
    ``same_class`` link the first note of a class to each other note, all of which are pairs too.
    """
    across, member = structural_classes(edges, threshold)
    cols = [F.col("a").alias("left"), F.col("b").alias("right"), "shared", "union_size"]
    star = member.where("path <> rep").select(F.col("rep").alias("left"), F.col("path").alias("right"), F.col("n").alias("shared"), F.col("n").alias("union_size"))
    rows = across.select(*cols, F.lit(False).alias("same_class")).unionByName(star.withColumn("same_class", F.lit(True)))
    score = F.round(F.col("shared") / F.col("union_size"), 6).alias("score")
    return rows.select("left", "right", score, "shared", "union_size", F.lit("jaccard").alias("method"), F.lit(False).alias("semantic"), "same_class")


def structural_pairs(edges: DataFrame, threshold: float = 0.25, limit: int | None = 100) -> DataFrame:
    """(left, right, score, shared, union_size, method, semantic): the first pairs, a report.

    With a limit, a class takes part with its first limit + 1 notes, as no later one can be
    among the first pairs; structural_links has all pairs by classes.
    """
    across, member = structural_classes(edges, threshold)
    if limit is not None:
        # First within parts of a class, then of these few: no class is sorted by one task.
        part = F.pmod(F.xxhash64("path"), F.lit(PARTS))
        for w in (Window.partitionBy("rep", part), Window.partitionBy("rep")):
            member = member.withColumn("r", F.row_number().over(w.orderBy("path"))).where(F.col("r") <= limit + 1).drop("r")
    within = member.where("members > 1").select(F.col("rep").alias("a"), F.col("rep").alias("b"), F.col("n").alias("shared"), F.col("n").alias("union_size")).distinct()
    x = across.unionByName(within).join(member.select(F.col("rep").alias("a"), F.col("path").alias("p")), "a")
    y = x.join(member.select(F.col("rep").alias("b"), F.col("path").alias("q")), "b")
    y = y.where((F.col("a") != F.col("b")) | (F.col("p") < F.col("q")))
    out = y.select(
        F.least("p", "q").alias("left"),
        F.greatest("p", "q").alias("right"),
        F.round(F.col("shared") / F.col("union_size"), 6).alias("score"),
        "shared",
        "union_size",
        F.lit("jaccard").alias("method"),
        F.lit(False).alias("semantic"),
    ).orderBy(F.col("score").desc(), "left", "right")
    return out.limit(limit) if limit is not None else out


def communities(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(path, community): label propagation, deterministic.

    Each round a vertex takes the most frequent label around it, keeps its own where that is among
    them, else the largest. Of neighbours that would move, only the one of largest hash does: so
    every move adds edges within a label, no state can come back, and the rounds end. Stops when
    no vertex would move. A community is named by its smallest path.
    """
    nbrs = cut_round(neighbour_pairs(edges))
    labels = cut_round(vertices.select("path", F.xxhash64("path").alias("label")))
    order = lambda c: F.struct(F.xxhash64(c), F.col(c))
    while True:
        around = nbrs.join(labels.select(F.col("path").alias("nbr"), "label"), "nbr")
        ranked = around.groupBy("path", "label").agg(F.count(F.lit(1)).alias("n")).join(labels.withColumnRenamed("label", "own"), "path")
        best = ranked.groupBy("path", "own").agg(F.max(F.struct("n", (F.col("label") == F.col("own")).alias("kept"), "label")).alias("b"))
        news = cut_round(best.where("b.label <> own").select("path", F.col("b.label").alias("new")))
        if news.isEmpty():
            break
        a, b = news.select("path"), news.select(F.col("path").alias("nbr"))
        waits = nbrs.join(a, "path").join(b, "nbr").where(order("path") < order("nbr")).select("path").distinct()
        moves = news.join(waits, "path", "left_anti")
        labels = cut_round(labels.join(moves, "path", "left").select("path", F.coalesce("new", "label").alias("label")))
    names = labels.groupBy("label").agg(F.min("path").alias("community"))
    return labels.join(names, "label").select("path", "community")


def community_report(members: DataFrame, groups: int = 10, each: int = 5) -> DataFrame:
    """(community, size, members): the largest groups with their first members."""
    sizes = members.groupBy("community").agg(F.count(F.lit(1)).alias("size")).orderBy(F.col("size").desc(), "community").limit(groups)
    rank = F.row_number().over(Window.partitionBy("community").orderBy("path"))
    first = members.join(F.broadcast(sizes), "community").withColumn("r", rank).where(F.col("r") <= each)
    return first.groupBy("community", "size").agg(F.sort_array(F.collect_list("path")).alias("members")).orderBy(F.col("size").desc(), "community")


def vault_stats(files: DataFrame, notes: DataFrame, dirs: DataFrame) -> DataFrame:
    """(measure, dir, n): tracked files, notes, folders, and notes per top folder."""
    row = lambda df, name: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("measure"), F.lit("").alias("dir"), "n")
    per = notes.groupBy(top_dir(F.col("path"), F.lit(".")).alias("dir")).agg(F.count(F.lit(1)).alias("n"))
    parts = [row(files, "files"), row(notes, "notes"), row(dirs, "dirs"), per.select(F.lit("notes_in").alias("measure"), "dir", "n")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
