"""Queries of the training-data operators: name -> f(spark, sf_dir), and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkmesh.llm import format_dupes, languages, leakage, near_dupes, packing, set_join, shared_spans
from inkmesh.session import read_table

Query = Callable[[SparkSession, str], DataFrame]


def _notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "notes").select(F.col("note_id").alias("id"), F.col("content").alias("text"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = shared_spans.shared_span_pairs(_notes(spark, sf_dir))
    return pairs.select(F.col("a").alias("note_a"), F.col("b").alias("note_b"))


def p1_shared_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared_spans.shared_part(_notes(spark, sf_dir)).withColumnRenamed("id", "note_id")


def p1_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shared passages of each note with its path and the class of its text; p1_holders names the classes that hold them."""
    notes = read_table(spark, sf_dir, "notes").select(F.col("note_id").alias("id"), "path").dropDuplicates(["id"])
    spans = shared_spans.shared_passages(_notes(spark, sf_dir)).join(notes, "id")
    return spans.select(F.col("id").alias("note_id"), "path", F.col("rep").alias("class_id"), "start", "length", "n_records", "passage")


def p1_holders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stretches of a class's passages (class_id, start) that other classes hold; the notes and paths of a class are in p1_passages."""
    _, holders, _ = shared_spans.passage_holders(_notes(spark, sf_dir))
    return holders.select(F.col("rep").alias("class_id"), "start", F.col("other").alias("other_class"), "held_start", "held_length")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_dupes.copy_pairs(read_table(spark, sf_dir, "exact_rows"))


def p2_collapsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_dupes.collapse(read_table(spark, sf_dir, "exact_rows"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = near_dupes.near_duplicate_pairs(_notes(spark, sf_dir), tau=0.7, width=3)
    return pairs.select(F.col("a").alias("note_a"), F.col("b").alias("note_b"))


def p4_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dupes.near_duplicate_groups(_notes(spark, sf_dir), tau=0.7, width=3).withColumnRenamed("id", "note_id")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return set_join.similar_pairs(read_table(spark, sf_dir, "neighborhoods"), tau=0.5)


def p5_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return set_join.links_per_record(read_table(spark, sf_dir, "neighborhoods"), tau=0.5)


def p6_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.token_counts(read_table(spark, sf_dir, "documents")))


def p6_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.summary(p6_containers(spark, sf_dir))


def p7_alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p7_alignments(spark, sf_dir).where(F.col("longest_run") >= leakage.RUN).select("doc_id", "item_id")


def _detected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages.detect(read_table(spark, sf_dir, "documents"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages.mislabelled(_detected(spark, sf_dir))


def p8_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages.languages(_detected(spark, sf_dir))


def p8_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages.segments(_detected(spark, sf_dir))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        p1_found,
        p1_shared_part,
        p1_passages,
        p1_holders,
        p2_found,
        p2_collapsed,
        p4_found,
        p4_groups,
        p5_found,
        p5_links,
        p6_containers,
        p6_summary,
        p7_found,
        p7_alignments,
        p8_found,
        p8_languages,
        p8_segments,
    )
}

_GRAMS = """
WITH d AS (SELECT note_id, any_value(content) AS t FROM notes WHERE content IS NOT NULL GROUP BY note_id),
g AS (SELECT DISTINCT note_id, substring(t, CAST(i AS INTEGER), 150) AS g
      FROM (SELECT note_id, t, unnest(range(1, length(t) - 148)) AS i FROM d WHERE length(t) >= 150))
SELECT DISTINCT x.note_id AS note_a, y.note_id AS note_b FROM g x JOIN g y ON x.g = y.g AND x.note_id < y.note_id
"""
_PLAIN = "lower(regexp_replace({}, '[^\\p{{L}}\\p{{N}}]+', '', 'g'))"
_COPIES = f"""
WITH r AS (SELECT DISTINCT row_id, {_PLAIN.format("sha256")} AS d, count AS c,
  list_sort(list_transform(paths, lambda x: {_PLAIN.format("x")})) AS p
  FROM exact_rows WHERE row_id IS NOT NULL AND sha256 IS NOT NULL AND paths IS NOT NULL),
k AS (SELECT d, c, p, min(row_id) AS first_id, count(*) AS n FROM r GROUP BY d, c, p)
"""
_SHINGLES = """
WITH d AS (SELECT note_id, regexp_extract_all(lower(any_value(content)), '[\\p{L}\\p{N}]+') AS w
           FROM notes WHERE content IS NOT NULL GROUP BY note_id),
s AS (SELECT DISTINCT note_id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS s
      FROM (SELECT note_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)),
n AS (SELECT note_id, count(*) AS n FROM s GROUP BY note_id),
p AS (SELECT x.note_id AS a, y.note_id AS b, count(*) AS i FROM s x JOIN s y ON x.s = y.s AND x.note_id < y.note_id GROUP BY 1, 2)
SELECT a AS note_a, b AS note_b FROM p JOIN n na ON na.note_id = a JOIN n nb ON nb.note_id = b
WHERE i / (na.n + nb.n - i) >= 0.7
"""
_SETS = """
WITH e AS (SELECT DISTINCT set_id, x FROM (SELECT set_id, unnest(neighbors) AS x FROM neighborhoods) WHERE x IS NOT NULL),
n AS (SELECT set_id, count(*) AS n FROM e GROUP BY set_id),
p AS (SELECT x.set_id AS a, y.set_id AS b, count(*) AS i FROM e x JOIN e y ON x.x = y.x AND x.set_id < y.set_id GROUP BY 1, 2)
SELECT a AS set_a, b AS set_b FROM p JOIN n na ON na.set_id = a JOIN n nb ON nb.set_id = b
WHERE i / (na.n + nb.n - i) >= 0.5
"""

_SHARED = """
WITH d AS (SELECT note_id, any_value(content) AS t FROM notes WHERE content IS NOT NULL GROUP BY note_id),
g AS (SELECT note_id, i, substring(t, CAST(i AS INTEGER), 150) AS g FROM (SELECT note_id, t, unnest(range(1, length(t) - 148)) AS i FROM d WHERE length(t) >= 150)),
k AS (SELECT g FROM g GROUP BY g HAVING count(DISTINCT note_id) > 1),
s AS (SELECT note_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY note_id ORDER BY i) <= 150 THEN 0 ELSE 1 END AS n FROM g WHERE g IN (SELECT g FROM k)),
u AS (SELECT note_id, i, sum(n) OVER (PARTITION BY note_id ORDER BY i) AS p FROM s),
p AS (SELECT note_id, p, max(i) + 150 - min(i) AS l FROM u GROUP BY 1, 2),
x AS (SELECT note_id, count(*) AS n_passages, CAST(sum(l) AS BIGINT) AS shared_chars FROM p GROUP BY 1)
SELECT d.note_id, coalesce(n_passages, 0) AS n_passages, coalesce(shared_chars, 0) AS shared_chars, CAST(length(t) AS INTEGER) AS chars,
CASE WHEN length(t) > 0 THEN coalesce(shared_chars, 0) / length(t) ELSE 0.0 END AS shared_part FROM d LEFT JOIN x ON x.note_id = d.note_id
"""
_PASSAGES = """
WITH o AS (SELECT note_id, any_value(content) AS t, any_value(path) AS path FROM notes WHERE note_id IS NOT NULL GROUP BY note_id),
d AS (SELECT note_id, t, path, min(note_id) OVER (PARTITION BY t) AS rep FROM o WHERE length(t) >= 150),
c AS (SELECT rep, any_value(t) AS t, count(*) AS copies FROM d GROUP BY rep),
g AS (SELECT rep, i, substring(t, CAST(i AS INTEGER), 150) AS g FROM (SELECT rep, t, unnest(range(1, length(t) - 148)) AS i FROM c)),
k AS (SELECT g FROM g JOIN c ON c.rep = g.rep GROUP BY g HAVING count(DISTINCT g.rep) > 1 OR max(copies) > 1),
s AS (SELECT rep, i, g.g, CASE WHEN i - lag(i) OVER (PARTITION BY rep ORDER BY i) <= 150 THEN 0 ELSE 1 END AS n FROM g JOIN k ON k.g = g.g),
u AS (SELECT rep, i, g, sum(n) OVER (PARTITION BY rep ORDER BY i) AS p FROM s),
p AS (SELECT rep, p, min(i) - 1 AS start, max(i) + 150 - min(i) AS length FROM u GROUP BY rep, p),
m AS (SELECT DISTINCT u.rep, u.p, u.i, x.rep AS other, x.i AS at FROM u JOIN g x ON x.g = u.g AND x.rep <> u.rep)
"""
_CLASSES = """, c AS (SELECT {id} AS id, min({id}) OVER (PARTITION BY f) AS rep FROM (SELECT {id}, list_sort(list({value})) AS f FROM {sets} GROUP BY {id})),
n AS (SELECT {id}, count(*) AS n FROM {sets} GROUP BY {id}),
r AS (SELECT x.* FROM {sets} x JOIN (SELECT DISTINCT rep FROM c) ON rep = x.{id}),
i AS (SELECT x.{id} AS a, y.{id} AS b, count(*) AS i FROM r x JOIN r y ON x.{value} = y.{value} AND x.{id} < y.{id} GROUP BY 1, 2),
p AS (SELECT a, b, i / (na.n + nb.n - i) AS score FROM i JOIN n na ON na.{id} = a JOIN n nb ON nb.{id} = b WHERE i / (na.n + nb.n - i) >= {tau}),
e AS (SELECT a, b, score FROM p UNION ALL SELECT b, a, score FROM p),
m AS (SELECT rep, count(*) AS copies FROM c GROUP BY rep), l AS (SELECT a AS rep, count(*) AS linked, max(score) AS best FROM e GROUP BY a)
"""
_GROUPS = (
    """WITH RECURSIVE d AS (SELECT note_id, regexp_extract_all(lower(any_value(content)), '[\\p{L}\\p{N}]+') AS w FROM notes WHERE content IS NOT NULL GROUP BY note_id),
s AS (SELECT DISTINCT note_id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS s FROM (SELECT note_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3))"""
    + _CLASSES.format(id="note_id", value="s", sets="s", tau=0.7)
    + """, t AS (SELECT rep AS x, rep AS y FROM m UNION SELECT t.x, e.b FROM t JOIN e ON e.a = t.y)
SELECT c.id AS note_id, c.rep AS class_id, gr.g AS group_id, copies, coalesce(linked, 0) AS linked
FROM c JOIN m ON m.rep = c.rep JOIN (SELECT x, min(y) AS g FROM t GROUP BY x) gr ON gr.x = c.rep LEFT JOIN l ON l.rep = c.rep"""
)
_LINKED = (
    "WITH s AS (SELECT DISTINCT set_id, x FROM (SELECT set_id, unnest(neighbors) AS x FROM neighborhoods) WHERE x IS NOT NULL)"
    + _CLASSES.format(id="set_id", value="x", sets="s", tau=0.5)
    + """SELECT c.id AS set_id, c.rep AS class_id, copies, coalesce(linked, 0) AS linked_classes, CASE WHEN copies > 1 THEN 1.0 ELSE best END AS best_score
FROM c JOIN m ON m.rep = c.rep LEFT JOIN l ON l.rep = c.rep"""
)
_LEAKS = r"""
WITH s AS (SELECT doc_id, regexp_replace(array_to_string(list_filter(string_split(replace(text, chr(13), ''), chr(10)),
    lambda x: NOT contains(x, '-->') AND regexp_matches(x, '\p{L}')), chr(10)),
    '<[^<>\n]*>|\{[^{}\n]*\}|\[[^\[\]\n]*\]|\([^()\n]*\)', '', 'g') AS t
  FROM documents WHERE text IS NOT NULL),
d AS (SELECT doc_id, regexp_extract_all(lower(t), '[\p{L}\p{N}]+') AS w FROM s),
b AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM benchmark WHERE text IS NOT NULL),
dg AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 11], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS i FROM d)),
bg AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 11], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS i FROM b))
SELECT DISTINCT doc_id, item_id FROM dg JOIN bg ON dg.g = bg.g
"""

ORACLE_SQL: dict[str, str] = {
    "p1_shared_part": _SHARED,
    "p1_passages": _PASSAGES
    + """, h AS (SELECT rep, p, sum(copies) AS n FROM (SELECT DISTINCT rep, p, other FROM m) y JOIN (SELECT rep AS other, copies FROM c) z ON z.other = y.other GROUP BY rep, p)
SELECT d.note_id, d.path, d.rep AS class_id, p.start, p.length, CAST(c.copies + coalesce(h.n, 0) AS BIGINT) AS n_records,
sha256(substring(c.t, CAST(p.start + 1 AS INTEGER), CAST(p.length AS INTEGER))) AS passage
FROM p JOIN c ON c.rep = p.rep JOIN d ON d.rep = p.rep LEFT JOIN h ON h.rep = p.rep AND h.p = p.p""",
    "p1_holders": _PASSAGES
    + """, w AS (SELECT rep, p, other, i, CASE WHEN i - lag(i) OVER (PARTITION BY rep, p, other ORDER BY i) <= 150 THEN 0 ELSE 1 END AS n FROM (SELECT DISTINCT rep, p, other, i FROM m)),
q AS (SELECT rep, p, other, i, sum(n) OVER (PARTITION BY rep, p, other ORDER BY i) AS k FROM w),
r AS (SELECT rep, p, other, min(i) - 1 AS held_start, max(i) + 150 - min(i) AS held_length FROM q GROUP BY rep, p, other, k)
SELECT r.rep AS class_id, p.start, r.other AS other_class, held_start, held_length FROM r JOIN p ON p.rep = r.rep AND p.p = r.p""",
    "p4_groups": _GROUPS,
    "p5_links": _LINKED,
    "p7_found": _LEAKS,
    "p1_found": _GRAMS,
    "p2_found": _COPIES + "SELECT first_id, row_id FROM r JOIN k ON r.d = k.d AND r.p = k.p AND r.c IS NOT DISTINCT FROM k.c WHERE row_id <> first_id",
    "p2_collapsed": _COPIES
    + """, m AS (SELECT row_id, first_id, n FROM r JOIN k ON r.d = k.d AND r.p = k.p AND r.c IS NOT DISTINCT FROM k.c),
    o AS (SELECT row_id, any_value(sha256) AS sha256, CAST(any_value(len(paths)) AS INTEGER) AS n_paths, any_value(count) AS count FROM exact_rows WHERE row_id IS NOT NULL GROUP BY row_id)
    SELECT o.row_id, o.sha256, o.n_paths, o.count, coalesce(n, 1) AS copies FROM o LEFT JOIN m ON o.row_id = m.row_id
    WHERE first_id IS NULL OR first_id = o.row_id""",
    "p4_found": _SHINGLES,
    "p5_found": _SETS,
}
