"""SQL of the core queries, written independently of the operators, for DuckDB."""

from __future__ import annotations

# The vault: living notes with their logged link tokens below the text.
VAULT = r"""
WITH lk AS (SELECT DISTINCT link_id, src, kind, raw FROM links WHERE raw IS NOT NULL AND src IS NOT NULL),
tk AS (SELECT src, string_agg(CASE WHEN kind = 'wikilink' THEN '[[' || raw || ']]' ELSE '[x](' || raw || ')' END, chr(10) ORDER BY link_id) AS t FROM lk GROUP BY src),
ln AS (SELECT DISTINCT note_id, path, content, created_at FROM notes WHERE deleted_at IS NULL AND path IS NOT NULL),
nt AS (SELECT path, content FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY created_at DESC, note_id DESC) AS r FROM ln) WHERE r = 1),
v AS (SELECT path, coalesce(content, '') || chr(10) || coalesce(t, '') AS text FROM nt LEFT JOIN tk ON nt.path = tk.src),
f AS (SELECT path FROM nt UNION SELECT path FROM shared_files WHERE deleted_at IS NULL AND path IS NOT NULL),
dr AS (SELECT DISTINCT array_to_string(p[1:k], '/') AS dir FROM (SELECT string_split(path, '/') AS p, unnest(range(1, len(string_split(path, '/')))) AS k FROM f)),
nm AS (SELECT path, regexp_replace(string_split(path, '/')[-1], '(.)\.[^.]+$', '\1') AS stem FROM v),
st AS (SELECT stem, max(path) AS winner, list_sort(list(path)) AS candidates, count(*) AS n FROM nm GROUP BY stem),
wl AS (SELECT path AS src, regexp_replace(trim(string_split(b, '|')[1], chr(32) || chr(9) || chr(10) || chr(13)), '^!+', '') AS r0
       FROM (SELECT path, unnest(regexp_extract_all(text, '\[\[([^\]\n]+)\]\]', 1)) AS b FROM v)),
tg AS (SELECT src, string_split(r0, '#')[1] AS raw FROM wl)
"""


def _norm(p: str) -> str:
    """POSIX normpath of a relative path."""
    step = (
        "CASE WHEN x IN ('', '.') THEN acc WHEN x = '..' AND acc <> '' AND acc <> '..' AND NOT ends_with(acc, '/..') "
        "THEN regexp_replace(acc, '/?[^/]*$', '') WHEN acc = '' THEN x ELSE acc || '/' || x END"
    )
    return f"coalesce(nullif(list_reduce(list_prepend('', string_split({p}, '/')), lambda acc, x: {step}), ''), '.')"


_FOLDER = "regexp_replace(src, '/?[^/]*$', '')"


def _resolved(links: str, keys: str, out: str) -> str:
    return f"""{keys} AS (SELECT src, raw, replace(raw, '.md', '') AS k0, {_norm("raw")} AS k1, {_norm("raw || '.md'")} AS k2,
  {_norm(_FOLDER + " || '/' || raw")} AS k3, {_norm(_FOLDER + " || '/' || raw || '.md'")} AS k4 FROM {links}),
{out} AS (SELECT src, raw, coalesce(st.winner, a.path, b.path, c.path, d.path) AS target FROM {keys}
  LEFT JOIN st ON st.stem = k0 LEFT JOIN v a ON a.path = k1 LEFT JOIN v b ON b.path = k2 LEFT JOIN v c ON c.path = k3 LEFT JOIN v d ON d.path = k4)"""


RESOLVE = (
    VAULT
    + f""", dt AS (SELECT DISTINCT src, raw FROM tg WHERE raw <> ''),
{_resolved("dt", "ky", "rs")},
e AS (SELECT DISTINCT src, target AS dst FROM rs WHERE target IS NOT NULL AND target <> src),
dg AS (SELECT v.path, coalesce(i.n, 0) AS in_degree, coalesce(o.n, 0) AS out_degree, coalesce(i.n, 0) + coalesce(o.n, 0) AS degree FROM v
  LEFT JOIN (SELECT dst, count(*) AS n FROM e GROUP BY dst) i ON i.dst = v.path LEFT JOIN (SELECT src, count(*) AS n FROM e GROUP BY src) o ON o.src = v.path),
nb AS (SELECT src AS path, dst AS nbr FROM e UNION SELECT dst, src FROM e),
oc AS (SELECT dg.path, CASE WHEN in_degree > 0 AND out_degree > 0 THEN 'connected' WHEN out_degree > 0 THEN 'only_outgoing' WHEN in_degree > 0 THEN 'only_incoming' ELSE 'zero_both' END AS class,
  CASE WHEN degree = 0 THEN CASE WHEN regexp_matches(v.text, '\\[\\[([^\\]\\n]+)\\]\\]') THEN 'broken' ELSE 'none' END END AS zero FROM dg JOIN v ON v.path = dg.path),
hub AS (SELECT path FROM dg ORDER BY degree DESC, path LIMIT 1)
"""
)
STATUS = (
    RESOLVE
    + f""", ss AS (SELECT src, raw, trim(raw) AS t, regexp_replace(string_split(trim(raw), '/')[-1], '(.)\\.[^.]+$', '\\1') AS stem FROM dt),
dz AS (SELECT DISTINCT src, t AS raw FROM ss),
{_resolved("dz", "kz", "rz")},
sx AS (SELECT ss.src, ss.raw, CASE WHEN st.n > 1 AND NOT contains(t, '/') THEN 'ambiguous' WHEN rz.target IS NOT NULL THEN 'resolved' ELSE 'missing' END AS status,
  CASE WHEN st.n > 1 AND NOT contains(t, '/') THEN st.candidates WHEN rz.target IS NOT NULL THEN [rz.target] ELSE [] END AS candidates
  FROM ss JOIN rz ON rz.src = ss.src AND rz.raw = ss.t LEFT JOIN st ON st.stem = ss.stem)
"""
)
_TOP = "CASE WHEN contains(path, '/') THEN string_split(path, '/')[1] ELSE '.' END"
_PAIRS = (
    RESOLVE
    + """, sz AS (SELECT path, count(*) AS n FROM nb GROUP BY path),
pr AS (SELECT a.path AS l, b.path AS r, count(*) AS shared FROM nb a JOIN nb b ON a.nbr = b.nbr AND a.path < b.path GROUP BY 1, 2),
sp AS (SELECT l AS "left", r AS "right", round(shared / (x.n + y.n - shared), 6) AS score, shared, x.n + y.n - shared AS union_size, 'jaccard' AS method, false AS semantic
  FROM pr JOIN sz x ON x.path = l JOIN sz y ON y.path = r WHERE shared / (x.n + y.n - shared) >= 0.25 ORDER BY 3 DESC, 1, 2 LIMIT 100)
"""
)
LIVING = r"""
WITH ln AS (SELECT DISTINCT note_id, path, content, created_at FROM notes WHERE deleted_at IS NULL AND path IS NOT NULL),
v AS (SELECT path, replace(replace(content, chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS text
  FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY created_at DESC, note_id DESC) AS r FROM ln) WHERE r = 1 AND content IS NOT NULL),
b AS (SELECT path, text, CASE WHEN starts_with(text, '---' || chr(10)) AND strpos(text[5:], chr(10) || '---' || chr(10)) > 0
  THEN text[4 + strpos(text[5:], chr(10) || '---' || chr(10)) + 5:] ELSE text END AS body FROM v)
"""
_BLANK = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_GROUPED = """SELECT h AS sha256, list_transform(list_sort(list(struct_pack(k := string_split(path, '/'), p := path))), lambda x: x.p) AS paths,
 count(*) AS count, 'exact' AS method, {} AS includes_frontmatter FROM g GROUP BY h HAVING count(*) > 1"""
_CLEAN_LINES = "array_to_string(list_transform(string_split({}, chr(10)), lambda x: rtrim(x, " + _BLANK + ")), chr(10))"

SQL: dict[str, str] = {
    "vault_stats": VAULT
    + f"""SELECT 'files' AS measure, '' AS dir, count(*) AS n FROM f UNION ALL SELECT 'notes', '', count(*) FROM v UNION ALL SELECT 'dirs', '', count(*) FROM dr
UNION ALL SELECT 'notes_in', {_TOP}, count(*) FROM v GROUP BY 2""",
    "stems": VAULT + "SELECT stem, winner, candidates, n FROM st",
    "notes_by_dir": VAULT + "SELECT regexp_replace(path, '/?[^/]*$', '') AS dir, list_sort(list(path)) AS paths FROM v GROUP BY 1",
    "wikilink_tokens": VAULT + "SELECT src, raw, count(*) AS n FROM tg GROUP BY 1, 2",
    "edges": RESOLVE + "SELECT src, dst FROM e",
    "degrees": RESOLVE + "SELECT path, in_degree, out_degree, degree FROM dg",
    "hubs": RESOLVE + "SELECT path, in_degree, out_degree, degree FROM dg ORDER BY degree DESC, path LIMIT 20",
    "islands": RESOLVE + "SELECT path, degree FROM dg WHERE degree <= 1",
    "link_stats": RESOLVE + "SELECT count(*) AS notes, count(*) FILTER (out_degree > 0) AS linked_notes, CAST(sum(out_degree) AS BIGINT) AS edges FROM dg",
    "orphan_classes": RESOLVE + "SELECT path, class, zero FROM oc",
    "orphan_summary": RESOLVE + "SELECT class, count(*) AS notes, round(100.0 * count(*) / (SELECT count(*) FROM oc), 1) AS percent FROM oc GROUP BY class",
    "orphan_dirs": RESOLVE.replace("coalesce(content, '') || chr(10) || coalesce(t, '') AS text FROM nt LEFT JOIN tk ON nt.path = tk.src", "content AS text FROM nt WHERE content IS NOT NULL")
    + f"""SELECT {_TOP} AS dir, count(*) AS zero_both, count(*) FILTER (zero = 'none') AS "none", count(*) FILTER (zero = 'broken') AS broken
FROM oc WHERE class = 'zero_both' GROUP BY 1""",
    "wanted": RESOLVE + 'SELECT tg.raw AS target, count(*) AS "references" FROM tg JOIN rs ON rs.src = tg.src AND rs.raw = tg.raw WHERE target IS NULL GROUP BY 1',
    "resolve_status": STATUS + "SELECT src, raw, status, candidates FROM sx",
    "structural_pairs": _PAIRS + "SELECT * FROM sp",
    "similar": RESOLVE
    + """, own AS (SELECT nbr FROM nb JOIN hub ON nb.path = hub.path),
sh AS (SELECT path, count(*) AS i FROM nb WHERE nbr IN (SELECT nbr FROM own) GROUP BY path), sz AS (SELECT path, count(*) AS n FROM nb GROUP BY path)
SELECT v.path, round(coalesce(i / (n + (SELECT count(*) FROM own) - i), 0), 6) AS score, 'jaccard' AS method, false AS semantic
FROM v LEFT JOIN sh ON sh.path = v.path LEFT JOIN sz ON sz.path = v.path WHERE v.path <> (SELECT path FROM hub) ORDER BY score DESC, v.path LIMIT 10""",
    "neighbors_d1": RESOLVE
    + """SELECT path, 0 AS hop, 'anchor' AS relation FROM hub UNION ALL
SELECT x, 1, min(r) FROM (SELECT dst AS x, 'outgoing' AS r FROM e JOIN hub ON src = path UNION ALL SELECT src, 'backlink' FROM e JOIN hub ON dst = path) GROUP BY x""",
    "context": RESOLVE
    + """SELECT * FROM (SELECT path, 0 AS hop, 'anchor' AS relation FROM hub UNION ALL
SELECT x, 1, min(r) FROM (SELECT dst AS x, 'outgoing' AS r FROM e JOIN hub ON src = path UNION ALL SELECT src, 'backlink' FROM e JOIN hub ON dst = path) GROUP BY x)
ORDER BY hop, path LIMIT 50""",
    "review": _PAIRS
    + """, fx AS (SELECT v.path, octet_length(encode(text)) AS bytes, sha256(text) AS sha, in_degree, out_degree FROM v JOIN dg ON dg.path = v.path)
SELECT "left", "right", score, a.bytes AS left_bytes, b.bytes AS right_bytes, a.sha AS source_sha256, b.sha AS target_sha256, a.in_degree AS left_in, a.out_degree AS left_out,
b.in_degree AS right_in, b.out_degree AS right_out,
(SELECT list_sort(list(x.nbr)) FROM nb x JOIN nb y ON x.nbr = y.nbr WHERE x.path = "left" AND y.path = "right") AS shared_neighbors, 'review' AS action
FROM sp JOIN fx a ON a.path = "left" JOIN fx b ON b.path = "right" """,
    "plan": _PAIRS
    + """SELECT 'redirect' AS operation, "left" AS source, "right" AS target, true AS preserve_alias, true AS rewrite_inbound_links, true AS keep_source_file,
sha256(a.text) AS source_sha256, sha256(b.text) AS target_sha256 FROM sp JOIN v a ON a.path = "left" JOIN v b ON b.path = "right" """,
    "verify_plan": _PAIRS + """SELECT "left" AS source, "right" AS target, true AS ok, CAST([] AS VARCHAR[]) AS errors FROM sp""",
    "exact_members": LIVING
    + f", g AS (SELECT path, sha256(trim({_CLEAN_LINES.format('body')}, {_BLANK})) AS h FROM b) SELECT h AS sha256, path, count(*) OVER (PARTITION BY h) AS count FROM g QUALIFY count > 1",
    "exact_duplicates_whole": LIVING + ", g AS (SELECT path, sha256(text) AS h FROM v) " + _GROUPED.format("true"),
    "exact_duplicates": LIVING + f", g AS (SELECT path, sha256(trim({_CLEAN_LINES.format('body')}, {_BLANK})) AS h FROM b) " + _GROUPED.format("false"),
    "paragraph_duplicates": LIVING
    + f""", l AS (SELECT path, i, string_split(body, chr(10))[i] AS raw FROM (SELECT path, body, unnest(range(1, len(string_split(body, chr(10))) + 1)) AS i FROM b)),
m AS (SELECT path, i, raw, trim(raw, {_BLANK}) AS t, CASE WHEN regexp_matches(trim(raw, {_BLANK}), '^(```|~~~)') THEN 1 ELSE 0 END AS fence FROM l),
o AS (SELECT *, sum(fence) OVER (PARTITION BY path ORDER BY i) AS k FROM m),
s AS (SELECT *, CASE WHEN k % 2 = 1 OR fence = 1 OR t = '' OR regexp_matches(t, '^[#>]') THEN 1 ELSE 0 END AS stop FROM o),
u AS (SELECT *, sum(stop) OVER (PARTITION BY path ORDER BY i) AS island FROM s),
p AS (SELECT path, trim(string_agg(raw, chr(10) ORDER BY i), {_BLANK}) AS text FROM u WHERE stop = 0 GROUP BY path, island)
SELECT sha256(text) AS sha256, count(*) AS count, count(*) AS places, 'paragraph-exact' AS method FROM p WHERE length(text) >= 40 GROUP BY 1 HAVING count(DISTINCT path) > 1""",
    "group_sizes": STATUS
    + r""", y AS (SELECT path, text[5:3 + strpos(text[5:], chr(10) || '---' || chr(10)) + 1] AS m FROM v WHERE starts_with(text, '---' || chr(10)) AND strpos(text[5:], chr(10) || '---' || chr(10)) > 0),
gm AS (SELECT 'path:' || CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') ELSE '.' END AS name, path FROM v
UNION SELECT 'tag:' || trim(unnest(string_split(regexp_extract(m, '(?m)^tags: \[([^\]]*)\]$', 1), ','))), path FROM y WHERE regexp_matches(m, '(?m)^tags: \[[^\]]*\]$')
UNION SELECT 'type:' || regexp_extract(m, '(?m)^type: (.*)$', 1), path FROM y WHERE regexp_matches(m, '(?m)^type: .')
UNION SELECT 'status:' || regexp_extract(m, '(?m)^status: (.*)$', 1), path FROM y WHERE regexp_matches(m, '(?m)^status: .')
UNION SELECT 'health:orphan', path FROM dg WHERE degree = 0 UNION SELECT 'health:hub', path FROM dg WHERE degree >= 10
UNION SELECT 'health:broken-link', src FROM sx WHERE status <> 'resolved')
SELECT name, count(DISTINCT path) AS count FROM gm GROUP BY name""",
}
SQL["group_topk"] = SQL["group_sizes"].rsplit("SELECT name, count(DISTINCT path) AS count", 1)[0] + """, c AS (SELECT name, count(DISTINCT path) AS count FROM gm GROUP BY name)
SELECT name, string_split(name, ':')[1] AS kind, regexp_replace(name, '^[^:]*:', '') AS value,
CASE string_split(name, ':')[1] WHEN 'tag' THEN 'tag:#' || name[5:] WHEN 'path' THEN CASE name WHEN 'path:.' THEN 'path:/' ELSE name END WHEN 'health' THEN '' ELSE '[' || name || ']' END AS obsidian_query,
CASE WHEN name LIKE 'type:%' OR name LIKE 'status:%' THEN name END AS property_query, name LIKE 'health:%' AS requires_tool,
CASE name WHEN 'health:orphan' THEN 'inkmesh orphan' WHEN 'health:hub' THEN 'inkmesh graph -m hubs' WHEN 'health:broken-link' THEN 'inkmesh scan' END AS tool_command, count
FROM c ORDER BY count DESC, name LIMIT 20"""

_WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
DANGLING = f"""
WITH life AS (SELECT path, created_at AS s, deleted_at AS e, 'notes' AS tab FROM notes UNION SELECT path, added_at, deleted_at, 'shared_files' FROM shared_files),
names AS (SELECT string_split(path, '/')[-1] AS name, s, e, tab FROM life),
lk AS (SELECT DISTINCT ON (link_id) * FROM links WHERE seen_at IS NOT NULL),
t1 AS (SELECT *, trim(raw, {_WS}) AS t FROM lk WHERE raw IS NOT NULL),
t2 AS (SELECT *, CASE WHEN kind = 'wikilink' THEN regexp_replace(t, '\\\\?\\|.*$', '', 's')
  WHEN kind = 'markdown' THEN trim(regexp_replace(t, '\\s+("[^"]*"|''[^'']*'')\\s*$', ''), {_WS}) ELSE t END AS u FROM t1),
t3 AS (SELECT *, CASE WHEN kind = 'markdown' THEN url_decode(regexp_replace(u, '^<(.*)>$', '\\1', 's')) ELSE u END AS w FROM t2),
t4 AS (SELECT *, trim(ltrim(trim(string_split(w, '#')[1], {_WS}), '!'), {_WS}) AS x FROM t3),
t5 AS (SELECT *, ltrim(x, '/') AS y FROM t4 WHERE x <> '' AND NOT regexp_matches(x, '^[A-Za-z][A-Za-z0-9+.\\-]*:')),
pk AS (SELECT link_id, 0 AS slot, seen_at, {_norm("y")} AS k FROM t5 UNION SELECT link_id, 0, seen_at, {_norm(_FOLDER + " || '/' || y")} FROM t5 WHERE src IS NOT NULL AND NOT starts_with(x, '/')),
pe AS (SELECT link_id, slot, seen_at, unnest([k, k || '.md']) AS k FROM pk
  UNION SELECT link_id, CAST(i AS INTEGER), seen_at, candidates[i] FROM (SELECT link_id, seen_at, candidates, unnest(range(1, len(candidates) + 1)) AS i FROM lk) WHERE candidates[i] IS NOT NULL),
ne AS (SELECT link_id, 0 AS slot, seen_at, unnest([x, x || '.md']) AS k FROM t5 WHERE kind = 'wikilink' AND NOT contains(x, '/')),
rf AS (SELECT DISTINCT link_id, slot, seen_at FROM pe),
al AS (SELECT link_id, slot FROM pe JOIN life ON k = path AND s <= seen_at AND (e IS NULL OR seen_at < e)
  UNION SELECT link_id, slot FROM ne JOIN names ON k = name AND s <= seen_at AND (e IS NULL OR seen_at < e)),
lost AS (SELECT rf.* FROM rf ANTI JOIN al ON al.link_id = rf.link_id AND al.slot = rf.slot)
"""
SQL["p3_found"] = DANGLING + "SELECT link_id, slot FROM lost"
SQL["p3_report"] = (
    DANGLING
    + """, ev AS (SELECT link_id, slot, tab FROM pe JOIN life ON k = path UNION SELECT link_id, slot, tab FROM ne JOIN names ON k = name),
mn AS (SELECT link_id, slot, min(tab) AS tab FROM ev GROUP BY 1, 2)
SELECT coalesce(tab, 'none') AS referenced, strftime(seen_at, '%Y-%m') AS month, count(*) AS dangling, count(DISTINCT lost.link_id) AS links
FROM lost LEFT JOIN mn ON mn.link_id = lost.link_id AND mn.slot = lost.slot GROUP BY 1, 2"""
)
SQL["line_duplicates"] = rf"""
WITH l AS (SELECT doc_id, trim(unnest(regexp_split_to_array(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '[\n\x0b\x0c\x1c-\x1e\x{{85}}\x{{2028}}\x{{2029}}]')), {_WS}) AS t FROM documents WHERE text IS NOT NULL)
SELECT sha256(t) AS sha256, count(*) AS count FROM l WHERE length(t) >= 40 GROUP BY 1 HAVING min(CAST(doc_id AS VARCHAR)) < max(CAST(doc_id AS VARCHAR))"""

_CLEAN = (
    "trim(string_split(url_decode(regexp_replace(regexp_replace(trim({0}, " + _WS + "), '^([^\\s]+)\\s+[\"''].*[\"'']$', '\\1'), '^<(.*)>$', '\\1', 's')), '#')[1], " + _WS + ")"
)
_SITES = "categories|category|tags|tag|archives|archive|changelog|start|docs|guide|guides|tutorial|tutorials|blog|skills-market|advanced|uploads"
_CLASS = f"""CASE WHEN target = '' THEN 'anchor' WHEN regexp_matches(lower(target), '^[a-z][a-z0-9+.\\-]*:') THEN 'external'
WHEN regexp_matches(target, '^(?i:path|local_path|url|new_path|old_path|your-|example|todo|xxx|\\$.*|[0-9]+|\\.+|.*\\*.*|.*<.*>.*)$') THEN 'placeholder'
WHEN kind = 'markdown' AND (regexp_matches(lower(target), '^/?({_SITES})/') OR regexp_matches(lower(target), '^/.*\\.html?$')) THEN 'site_path'
WHEN kind = 'markdown' AND regexp_matches(lower(target), '[^/]\\.html?$') AND starts_with(src, '30-reference/') THEN 'html_doc' ELSE 'path' END"""


def _exists(tokens: str, out: str) -> str:
    """Distinct (src, kind, target) of path-like targets that exist."""
    t = "ltrim(target, '/')"
    return f"""{out}_k AS (SELECT DISTINCT src, kind, target, {t} AS t, {_norm(_FOLDER + " || '/' || " + t)} AS near, {_norm(t)} AS away FROM {tokens}),
{out}_b AS (SELECT src, kind, target, near AS b FROM {out}_k UNION SELECT src, kind, target, away FROM {out}_k WHERE NOT regexp_matches(t, '^\\.\\.?/')),
{out}_p AS (SELECT src, kind, target, b AS k FROM {out}_b UNION SELECT src, kind, target, unnest([b || '.md', b || '/README.md', b || '/index.md']) FROM {out}_b WHERE NOT ends_with(b, '.md')),
{out} AS (SELECT DISTINCT src, kind, target FROM {out}_p WHERE k IN (SELECT path FROM f UNION SELECT dir FROM dr)
  UNION SELECT src, kind, target FROM {out}_k WHERE kind = 'wikilink' AND regexp_replace(string_split(t, '/')[-1], '(.)\\.[^.]+$', '\\1') IN (SELECT stem FROM st))"""


SCAN = (
    VAULT
    + f""", cl AS (SELECT path AS src, regexp_replace(array_to_string(list_filter(string_split_regex(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '(?m)^[ \\t]*(?:```|~~~)[^\\n]*$'),
  lambda x, i: i % 2 = 1), ''), '`[^`\\n]+`', ' ', 'g') AS t FROM v),
m0 AS (SELECT src, unnest(regexp_extract_all(t, '(^|[^!])\\[([^\\]\\n]+)\\]\\((?:<([^>\\n]+)>|([^)\\n]+))\\)', 3)) AS g3, unnest(regexp_extract_all(t, '(^|[^!])\\[([^\\]\\n]+)\\]\\((?:<([^>\\n]+)>|([^)\\n]+))\\)', 4)) AS g4 FROM cl),
w0 AS (SELECT src, replace(unnest(regexp_extract_all(t, '\\[\\[([^\\]\\n]+)\\]\\]', 1)), '\\|', chr(1)) AS b FROM cl),
t0 AS (SELECT src, 'markdown' AS kind, trim(CASE WHEN g3 <> '' THEN g3 ELSE g4 END, {_WS}) AS shown FROM m0
  UNION ALL SELECT src, 'wikilink', replace(ltrim(trim(string_split(b, '|')[1], {_WS}), '!'), chr(1), '|') FROM w0),
t1 AS (SELECT row_number() OVER () AS id, *, {_CLEAN.format("shown")} AS target FROM t0),
tok AS (SELECT *, {_CLASS} AS class FROM t1),
pt AS (SELECT * FROM tok WHERE class = 'path'),
{_exists("pt", "ex")},
l0 AS (SELECT pt.* FROM pt ANTI JOIN ex ON ex.src = pt.src AND ex.kind = pt.kind AND ex.target = pt.target),
a0 AS (SELECT id, src, kind, {_CLEAN.format("trim(string_split(shown, '|')[1], " + _WS + ")")} AS target FROM l0 WHERE kind = 'wikilink' AND contains(shown, '|')),
a1 AS (SELECT *, {_CLASS} AS class FROM a0),
{_exists("a1", "ax")},
sv AS (SELECT id FROM a1 WHERE class <> 'path' UNION SELECT id FROM a1 JOIN ax ON ax.src = a1.src AND ax.kind = a1.kind AND ax.target = a1.target),
bl AS (SELECT l0.* FROM l0 ANTI JOIN sv ON sv.id = l0.id)
"""
)
_DEFAULT = "NOT (starts_with(src, '50-diary/') OR starts_with(src, '60-archive/') OR starts_with(src, '30-reference/references/bookmarks/archive/'))"
SQL["scan_tokens"] = SCAN + "SELECT src, kind, class, target, count(*) AS n FROM tok GROUP BY 1, 2, 3, 4"
SQL["broken_links"] = SCAN + "SELECT src, kind, shown AS target, count(*) AS n FROM bl GROUP BY 1, 2, 3"
SQL["broken_by_top_dir"] = SCAN + "SELECT CASE WHEN contains(src, '/') THEN string_split(src, '/')[1] ELSE src END AS dir, count(*) AS broken, min(src) AS first_src FROM bl GROUP BY 1"
SQL["broken_by_reference_dir"] = (
    SCAN + "SELECT array_to_string(string_split(src, '/')[1:2], '/') AS dir, count(*) AS broken, min(src) AS first_src FROM bl WHERE starts_with(src, '30-reference/') GROUP BY 1"
)
SQL["broken_by_file"] = SCAN + f"SELECT src, count(*) AS broken FROM bl WHERE {_DEFAULT} GROUP BY 1"
SQL["scan_summary"] = (
    SCAN
    + f"""SELECT (SELECT count(*) FROM v WHERE {_DEFAULT.replace("src", "path")}) AS scan_files, count(*) AS tokens,
count(*) FILTER (class = 'external') AS external_ignored, count(*) FILTER (class = 'placeholder') AS placeholder_ignored, count(*) FILTER (class = 'html_doc') AS html_doc_ignored,
count(*) FILTER (class = 'site_path') AS site_path_ignored, (SELECT count(*) FROM bl WHERE {_DEFAULT}) AS broken_total, (SELECT count(DISTINCT src) FROM bl WHERE {_DEFAULT}) AS broken_files,
(SELECT count(DISTINCT src) FROM bl WHERE {_DEFAULT} AND (src IN ('index.md', '30-reference/README.md') OR starts_with(src, '20-areas/') OR starts_with(src, '40-notes/'))) AS priority_files
FROM tok WHERE {_DEFAULT}"""
)
SQL["redirect_check"] = (
    RESOLVE
    + f""", r0 AS (SELECT path AS src, trim(regexp_extract(text, '(?m)^>\\s+Moved to\\s+\\[\\[([^\\]|#]+)(?:#[^\\]|]+)?(?:\\|[^\\]]+)?\\]\\]\\.?\\s*$', 1), {_WS}) AS raw FROM v),
rr AS (SELECT * FROM r0 WHERE raw <> ''),
{_resolved("rr", "kr", "xr")},
rd AS (SELECT xr.src AS source, CASE WHEN st.n > 1 AND NOT contains(raw, '/') THEN 'ambiguous' WHEN target IS NOT NULL THEN 'resolved' ELSE 'missing' END AS status,
  CASE WHEN st.n > 1 AND NOT contains(raw, '/') THEN st.candidates WHEN target IS NOT NULL THEN [target] ELSE [] END AS candidates,
  CASE WHEN target IS NOT NULL AND NOT (coalesce(st.n, 0) > 1 AND NOT contains(raw, '/')) THEN target ELSE raw END AS target
  FROM xr LEFT JOIN st ON st.stem = regexp_replace(string_split(raw, '/')[-1], '(.)\\.[^.]+$', '\\1')),
ch AS (SELECT rd.source, n.target AS at FROM rd JOIN rd n ON n.source = rd.target)
SELECT rd.source, rd.target, CASE WHEN rd.status = 'resolved' AND ch.source IS NOT NULL THEN 'chain' ELSE rd.status END AS status, rd.candidates,
ch.at AS final_target, rd.status = 'resolved' AND ch.source IS NULL AS ok FROM rd LEFT JOIN ch ON ch.source = rd.source"""
)
_PALE = "(CASE WHEN x <= 0.03928 THEN x / 12.92 ELSE pow((x + 0.055) / 1.055, 2.4) END)"
_LUM = "list_dot_product(list_transform([2, 4, 6], lambda i: list_transform([CAST('0x' || {0}[i:i + 1] AS INTEGER) / 255.0], lambda x: " + _PALE + ")[1]), [0.2126, 0.7152, 0.0722])"


def _contrast() -> str:
    """The pairs of each palette with their colours as rows."""
    from inkmesh.functions.color import NODE_PAIRS, PALETTES, TEXT_PAIRS

    rows = [
        f"('{theme}', '{kind}', '{a}', '{b}', '{c[a]}', '{c[b]}')"
        for theme, c in PALETTES.items()
        for kind, pairs in (("check", TEXT_PAIRS), ("conflict", NODE_PAIRS))
        for a, b in pairs
    ]
    return f"""WITH c AS (SELECT * FROM (VALUES {", ".join(rows)}) t(theme, kind, "first", "second", x, y)),
l AS (SELECT *, {_LUM.format("x")} AS lx, {_LUM.format("y")} AS ly FROM c),
r AS (SELECT *, round((greatest(lx, ly) + 0.05) / (least(lx, ly) + 0.05), 2) AS ratio FROM l)
SELECT theme, kind, "first", "second", ratio, ratio >= 2 AS ok FROM r"""


SQL["contrast_report"] = _contrast()
_TWO_HOPS = """, an AS (SELECT path, row_number() OVER (ORDER BY degree DESC, path) AS r FROM (SELECT * FROM dg ORDER BY degree DESC, path LIMIT {n})),
h1 AS (SELECT x AS path, min(struct_pack(r := r, how := how)) AS b FROM (SELECT dst AS x, r, 'outgoing' AS how FROM e JOIN an ON src = path {back}) WHERE x NOT IN (SELECT path FROM an) GROUP BY x)"""
SQL["neighbors_d2"] = (
    RESOLVE
    + _TWO_HOPS.format(n=3, back="")
    + """SELECT path, 0 AS hop, 'anchor' AS relation FROM an UNION ALL SELECT path, 1, b.how FROM h1
UNION ALL SELECT DISTINCT dst, 2, 'outgoing' FROM e JOIN h1 ON e.src = h1.path WHERE dst NOT IN (SELECT path FROM an) AND dst NOT IN (SELECT path FROM h1)"""
)
SQL["expand"] = (
    RESOLVE
    + _TWO_HOPS.format(n=5, back="UNION ALL SELECT src, r, 'backlink' FROM e JOIN (SELECT path, row_number() OVER (ORDER BY path) AS r FROM an) ON dst = path").replace(
        "SELECT path, row_number() OVER (ORDER BY degree DESC, path) AS r FROM", "SELECT path, degree, row_number() OVER (ORDER BY path) AS r FROM"
    )
    + """, ox AS (SELECT path, 0 AS hop, 'anchor' AS relation, 'input' AS source, degree / 100.0 AS anchor_score FROM an
UNION ALL SELECT path, 1, b.how, 'graph', NULL FROM h1)
SELECT path, hop, relation, source, CAST(anchor_score AS DOUBLE) AS anchor_score FROM ox ORDER BY hop, coalesce(anchor_score, 0) DESC, path LIMIT 50"""
)

_HEAD = "text[5:3 + strpos(text[5:], chr(10) || '---' || chr(10))]"
_HAS_HEAD = "starts_with(text, '---' || chr(10)) AND strpos(text[5:], chr(10) || '---' || chr(10)) > 0"
_RAW = r"""
WITH ln AS (SELECT DISTINCT note_id, path, content, created_at FROM notes WHERE deleted_at IS NULL AND path IS NOT NULL),
v AS (SELECT path, content AS text FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY created_at DESC, note_id DESC) AS r FROM ln) WHERE r = 1 AND content IS NOT NULL)
"""
SQL["frontmatter_tags"] = (
    _RAW
    + f""", y AS (SELECT path, {_HEAD} AS m FROM v WHERE {_HAS_HEAD})
SELECT path, trim(unnest(string_split(regexp_extract(m, '(?m)^tags: \\[([^\\]]*)\\]$', 1), ','))) AS tag FROM y WHERE regexp_matches(m, '(?m)^tags: \\[[^\\]]*\\]$')"""
)
SQL["note_aliases"] = SQL["frontmatter_tags"].replace("tags:", "aliases:").replace("AS tag", "AS alias")
SQL["titles"] = (
    _RAW
    + f"""SELECT path, trim(list_filter(string_split(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10))[1:60], lambda x: starts_with(x, '# '))[1][3:], {_WS}) AS title FROM v"""
)
_TWINS = (
    LIVING
    + f""", g AS (SELECT path, sha256(trim({_CLEAN_LINES.format("body")}, {_BLANK})) AS h FROM b),
tw AS (SELECT path AS source, t AS target FROM (SELECT path, min(path) OVER (PARTITION BY h) AS t FROM g) WHERE path <> t),
raw AS (SELECT path, content AS text FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY created_at DESC, note_id DESC) AS r FROM ln) WHERE r = 1 AND content IS NOT NULL)
"""
)
SQL["redirect_stubs"] = (
    _TWINS
    + f"""SELECT path, CASE WHEN {_HAS_HEAD} THEN '---' || chr(10) || {_HEAD} || chr(10) || '---' || chr(10) || chr(10) ELSE '' END || '> Moved to [[' || regexp_replace(target, '\\.md$', '') || ']].' || chr(10) AS new_text
FROM tw JOIN raw ON path = source"""
)
SQL["merge_drafts"] = (
    _TWINS
    + """, dd AS (SELECT regexp_replace(string_split(target, '/')[-1], '(.)\\.[^.]+$', '\\1') || '.merge-draft.md' AS path, source,
  b.text || chr(10) || chr(10) || '<!-- merged from ' || source || ' -->' || chr(10) || chr(10) || a.text AS text FROM tw JOIN raw a ON a.path = source JOIN raw b ON b.path = target)
SELECT path, arg_max(text, source) AS text FROM dd GROUP BY path"""
)
_SLUG = "replace(lower(trim(regexp_replace({0}, '[^\\p{{L}}\\p{{N}}\\p{{M}}_\\s-]', '', 'g'), " + _WS + ")), ' ', '-')"
FRAGMENTS = (
    SCAN
    + f""", fb AS (SELECT src, trim(string_split(unnest(regexp_extract_all(t, '\\[\\[([^\\]\\n]+)\\]\\]', 1)), '|')[1], {_WS}) AS full_raw FROM cl),
fd AS (SELECT src, full_raw, trim(string_split(full_raw, '#')[1], {_WS}) AS raw, nullif(CASE WHEN contains(full_raw, '#') THEN full_raw[strpos(full_raw, '#') + 1:] END, '') AS fragment FROM fb),
fz AS (SELECT DISTINCT src, raw FROM fd),
{_resolved("fz", "kf", "xf")},
fr AS (SELECT fd.*, xf.target, coalesce(st.n, 0) > 1 AND NOT contains(fd.raw, '/') AS twice FROM fd JOIN xf ON xf.src = fd.src AND xf.raw = fd.raw
  LEFT JOIN st ON st.stem = regexp_replace(string_split(fd.raw, '/')[-1], '(.)\\.[^.]+$', '\\1')),
ft AS (SELECT path, list_transform(regexp_extract_all(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '(?m)^#+[ \\t]+([^\\n]+)$', 1), lambda h: {_SLUG.format("h")}) AS hs,
  regexp_extract_all(text, '\\^([\\p{{L}}\\p{{N}}_-]+)', 1) AS bs FROM v)
"""
)
SQL["fragments"] = (
    FRAGMENTS
    + f"""SELECT fr.src AS file, CASE WHEN twice THEN NULL ELSE target END AS target, fragment, CASE WHEN twice THEN 'ambiguous' END AS status, CASE WHEN twice THEN st.candidates END AS candidates,
CASE WHEN twice THEN false WHEN starts_with(fragment, '^') THEN list_contains(bs, fragment[2:]) ELSE list_contains(hs, {_SLUG.format("fragment")}) END AS ok, count(*) AS n
FROM fr LEFT JOIN ft ON ft.path = target LEFT JOIN st ON twice AND st.stem = regexp_replace(string_split(fr.raw, '/')[-1], '(.)\\.[^.]+$', '\\1')
WHERE twice OR (target IS NOT NULL AND fragment IS NOT NULL) GROUP BY ALL"""
)
SQL["preflight"] = (
    FRAGMENTS
    + """, mv AS (SELECT regexp_replace(path, '\\.md$', '') AS old FROM v), nx AS (SELECT old AS name FROM mv UNION SELECT regexp_replace(string_split(old, '/')[-1], '(.)\\.[^.]+$', '\\1') FROM mv),
hit AS (SELECT src AS file, full_raw AS raw, CASE WHEN twice THEN 'ambiguous' ELSE 'missing' END AS status FROM fr WHERE (twice OR target IS NULL)
  AND (string_split(full_raw, '#')[1] IN (SELECT name FROM nx) OR regexp_replace(string_split(string_split(full_raw, '#')[1], '/')[-1], '(.)\\.[^.]+$', '\\1') IN (SELECT name FROM nx))),
mu AS (SELECT src AS file, trim(string_split(unnest(regexp_extract_all(t, '(^|[^!])\\[([^\\]\\n]+)\\]\\(([^)\\n]+)\\)', 3)), '#')[1], ' ') AS raw FROM cl)
SELECT file, raw, status, count(*) AS n FROM (FROM hit UNION ALL SELECT file, raw, 'unsafe' FROM mu WHERE regexp_matches(raw, '(^|/)\\.\\.(/|$)') AND regexp_replace(raw, '\\.md$', '') IN (SELECT old FROM mv)) GROUP BY ALL"""
)
SQL["paragraph_places"] = (
    SQL["paragraph_duplicates"].rsplit("p AS (SELECT path, trim(", 1)[0]
    + f"""p AS (SELECT path, min(i) AS line, trim(string_agg(raw, chr(10) ORDER BY i), {_BLANK}) AS text FROM u WHERE stop = 0 GROUP BY path, island),
q AS (SELECT text, count(*) AS count FROM p WHERE length(text) >= 40 GROUP BY 1 HAVING count(DISTINCT path) > 1)
SELECT sha256(p.text) AS sha256, path, CAST(line AS INTEGER) AS line, p.text AS text, count FROM p JOIN q ON p.text = q.text"""
)
_LINKED = (
    RESOLVE
    + """, ks AS (SELECT path, list_sort(list(nbr)) AS k, count(*) AS n FROM nb GROUP BY path),
kc AS (SELECT path, n, min(path) OVER (PARTITION BY k) AS rep FROM ks),
rn AS (SELECT nb.path, nbr, n FROM nb JOIN kc ON nb.path = kc.path AND kc.rep = kc.path),
sp AS (SELECT a.path AS "left", b.path AS "right", count(*) AS shared, any_value(a.n) + any_value(b.n) - count(*) AS union_size, false AS same_class
  FROM rn a JOIN rn b ON a.nbr = b.nbr AND a.path < b.path GROUP BY 1, 2 HAVING count(*) / (any_value(a.n) + any_value(b.n) - count(*)) >= 0.25
  UNION ALL SELECT rep, path, n, n, true FROM kc WHERE path <> rep)
"""
)
SQL["structural_links"] = _LINKED + """SELECT "left", "right", round(shared / union_size, 6) AS score, shared, union_size, 'jaccard' AS method, false AS semantic, same_class FROM sp"""
_SCORED = """, sq AS (SELECT "left", "right", round(shared / union_size, 6) AS score, same_class FROM sp)"""
SQL["review_links"] = _LINKED + _SCORED + SQL["review"][len(_PAIRS) :].replace('SELECT "left", "right", score,', 'SELECT "left", "right", score, same_class,').replace("FROM sp JOIN", "FROM sq JOIN")
SQL["plan_links"] = _LINKED + SQL["plan"][len(_PAIRS) :]
SQL["verify_plan_links"] = _LINKED + SQL["verify_plan"][len(_PAIRS) :]
SQL["alias_collisions"] = (
    _RAW
    + f""", y AS (SELECT path, {_HEAD} AS m FROM v WHERE {_HAS_HEAD}),
al AS (SELECT path, trim(unnest(string_split(regexp_extract(m, '(?m)^aliases: \\[([^\\]]*)\\]$', 1), ','))) AS alias FROM y WHERE regexp_matches(m, '(?m)^aliases: \\[[^\\]]*\\]$'))
SELECT 'old/' || alias || '.md' AS source, (SELECT min(path) FROM v) AS target, alias, path FROM al WHERE NOT ends_with(path, (SELECT min(path) FROM v))"""
)
_TABLE = "(starts_with({0}, '| ') AND (contains({0}[3:], ' |') OR regexp_matches({0}, '^\\| \\s*---')))"
SQL["fix_pipes"] = f"""
WITH lk AS (SELECT DISTINCT link_id, src, regexp_replace(raw, '[\\r\\n]', ' ', 'g') AS raw FROM links WHERE raw IS NOT NULL AND src IS NOT NULL),
h AS (SELECT * FROM (VALUES (1, '|', ''), (2, '||', ''), (3, '| ', ' |'), (4, '|| ', ' |'), (5, '||-', ''), (6, '| ---', ''), (7, '', '|'), (8, NULL, '|'), (9, NULL, '||')) t(k, a, b)),
ls AS (SELECT src AS path, link_id, k, CASE WHEN a IS NULL THEN b ELSE a || raw || b END AS s FROM lk CROSS JOIN h),
nw AS (SELECT *, CASE WHEN s = '|' THEN '' WHEN starts_with(s, '||-') THEN s[2:]
  WHEN starts_with(s, '||') AND ({_TABLE.format("s[2:]")} OR regexp_matches(s[2:], '^\\s*---')) THEN s[2:]
  WHEN starts_with(s, '||') THEN CASE WHEN trim(s[3:], {_BLANK}) = '' THEN '' ELSE s[3:] END
  WHEN starts_with(s, '|') AND NOT {_TABLE.format("s")} AND NOT regexp_matches(s[2:], '^\\s*---') THEN s[2:] ELSE s END AS x FROM ls)
SELECT path, CAST(count(*) FILTER (s <> x) AS INTEGER) AS changes, sha256(string_agg(x, chr(10) ORDER BY link_id, k) || chr(10)) AS sha256 FROM nw GROUP BY path HAVING count(*) FILTER (s <> x) > 0"""
_MANAGED = "source_file|tags|parent|topic|decision"
SQL["tidy_articles"] = (
    _RAW
    + f""", c AS (SELECT path, text, starts_with(text, '---' || chr(10)) AND strpos(text[5:], chr(10) || '---' || chr(10)) > 0 OR
    regexp_matches(text, '^---\\n(?s:.*?)\\n---$') AS good, strpos(text[5:], chr(10) || '---') AS at FROM v),
g AS (SELECT path, text, text[5:3 + strpos(text[5:], chr(10) || '---' || chr(10))] AS head, text[8 + strpos(text[5:], chr(10) || '---' || chr(10)) + 1:] AS rest FROM c WHERE good),
k AS (SELECT path, list_filter(string_split(head, chr(10)), lambda x: NOT regexp_matches(x, '^\\s*({_MANAGED})\\s*:')) AS kept, replace(regexp_replace(rest, '(?m)^-\\s*导入来源:.*(?:\\n|$)', '', 'g'), '[[index-2025|← 返回索引]]', '') AS rest FROM g)
SELECT path, CAST(NULL AS VARCHAR) AS error, sha256(array_to_string(list_concat(['---'], kept, ['tags: [wechat-archive]', 'parent: [[index-2025]]', '---', rtrim(regexp_replace(rest, '\\n{{3,}}', chr(10) || chr(10), 'g'), {_BLANK}), '', '[[index-2025|← 返回索引]]', '']), chr(10))) AS sha256 FROM k
UNION ALL SELECT path, 'missing YAML frontmatter', sha256(text) FROM c WHERE NOT good"""
)
_BACK = "`[^`\\n]*`"
SQL["migrate_links"] = (
    VAULT
    + f""", mv AS (SELECT DISTINCT regexp_replace(path, '\\.md$', '') AS old FROM v),
ls AS (SELECT path, i, l[i] AS s, regexp_matches(l[i], '^\\s*(```|~~~)') AS fence FROM (SELECT path, string_split(text, chr(10)) AS l, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM v)),
lf AS (SELECT path, i, s, fence OR sum(CAST(fence AS INTEGER)) OVER (PARTITION BY path ORDER BY i) % 2 = 1 AS code FROM ls),
pc AS (SELECT path, i, j, code, p[j] AS t FROM (SELECT path, i, code, p, unnest(range(1, len(p) + 1)) AS j FROM
  (SELECT path, i, code, CASE WHEN code THEN [s] ELSE regexp_extract_all(s, '{_BACK}|!?\\[\\[[^\\]\\n]+\\]\\]|!\\[|\\[[^\\]\\n]+\\]\\([^)\\n]+\\)|[^`!\\[]+|[`!\\[]') END AS p FROM lf))),
pb AS (SELECT path, i, j, t, CASE WHEN code THEN NULL WHEN regexp_matches(t, '^!?\\[\\[') THEN string_split(string_split(regexp_extract(t, '^!?\\[\\[([^\\]]+)\\]\\]$', 1), '|')[1], '#')[1]
  WHEN regexp_matches(t, '^\\[.+\\]\\(') THEN regexp_replace(string_split(regexp_extract(t, '^\\[[^\\]]+\\]\\(([^)]+)\\)$', 1), '#')[1], '\\.md$', '') END AS base FROM pc),
pn AS (SELECT path, i, j, CASE WHEN mv.old IS NULL THEN t WHEN regexp_matches(t, '^!?\\[\\[') THEN regexp_extract(t, '^!?\\[\\[') || 'moved/' || mv.old || t[strpos(t, '[[') + 2 + length(base):]
  ELSE regexp_extract(t, '^\\[[^\\]]+\\]\\(') || 'moved/' || mv.old || coalesce(nullif('#' || array_to_string(string_split(regexp_extract(t, '^\\[[^\\]]+\\]\\(([^)]+)\\)$', 1), '#')[2:], '#'), '#'), CASE WHEN contains(regexp_extract(t, '^\\[[^\\]]+\\]\\(([^)]+)\\)$', 1), '#') THEN '#' ELSE '' END) || ')' END AS t FROM pb LEFT JOIN mv ON mv.old = base),
jl AS (SELECT path, i, string_agg(t, '' ORDER BY j) AS s FROM pn GROUP BY path, i),
jn AS (SELECT lf.path, string_agg(coalesce(jl.s, ''), chr(10) ORDER BY lf.i) AS text FROM lf LEFT JOIN jl ON jl.path = lf.path AND jl.i = lf.i GROUP BY lf.path)
SELECT jn.path, sha256(jn.text) AS sha256 FROM jn JOIN v ON v.path = jn.path WHERE jn.text <> v.text"""
)
SQL["migration_stats"] = (
    RESOLVE
    + f""", mv AS (SELECT DISTINCT regexp_replace(path, '\\.md$', '') AS old FROM v),
wr AS (SELECT path AS src, trim(string_split(trim(string_split(unnest(regexp_extract_all(text, '\\[\\[([^\\]\\n]+)\\]\\]', 1)), '|')[1], {_WS}), '#')[1], {_WS}) AS raw FROM v),
wk AS (SELECT CASE WHEN coalesce(st.n, 0) > 1 AND NOT contains(raw, '/') THEN 'ambiguous' WHEN raw IN (SELECT old FROM mv) OR regexp_replace(string_split(raw, '/')[-1], '(.)\\.[^.]+$', '\\1') IN (SELECT old FROM mv)
  THEN 'rewritable' ELSE 'skipped' END AS kind FROM wr LEFT JOIN st ON st.stem = regexp_replace(string_split(raw, '/')[-1], '(.)\\.[^.]+$', '\\1')),
mu AS (SELECT path AS src, unnest(regexp_extract_all(text, '(^|[^!])\\[([^\\]\\n]+)\\]\\(([^)\\n]+)\\)', 3)) AS url FROM v),
mr AS (SELECT src, url, trim(string_split(url, '#')[1], {_WS}) AS raw, CASE WHEN contains(url, '#') THEN url[strpos(url, '#') + 1:] ELSE '' END AS fragment FROM mu),
mq AS (SELECT * FROM mr WHERE raw <> '' AND NOT regexp_matches(raw, '^(https?://|mailto:|#)')),
mz AS (SELECT DISTINCT src, raw FROM mq),
{_resolved("mz", "km", "xm")},
ft AS (SELECT path, list_transform(regexp_extract_all(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '(?m)^#+[ \\t]+([^\\n]+)$', 1), lambda h: {_SLUG.format("h")}) AS hs,
  regexp_extract_all(text, '\\^([\\p{{L}}\\p{{N}}_-]+)', 1) AS bs FROM v),
mk AS (SELECT CASE WHEN fragment <> '' AND target IS NOT NULL AND NOT (CASE WHEN starts_with(fragment, '^') THEN list_contains(bs, fragment[2:]) ELSE list_contains(hs, {_SLUG.format("fragment")}) END) THEN 'missing'
  WHEN mq.raw IN (SELECT old FROM mv) OR regexp_replace(mq.raw, '\\.md$', '') IN (SELECT old FROM mv) THEN 'rewritable' ELSE 'skipped' END AS kind
  FROM mq JOIN xm ON xm.src = mq.src AND xm.raw = mq.raw LEFT JOIN ft ON ft.path = target)
SELECT (SELECT count(*) FROM v) AS files_scanned, count(*) FILTER (kind <> 'missing') AS links_scanned, count(*) FILTER (kind = 'rewritable') AS links_rewritable,
count(*) FILTER (kind = 'skipped') AS links_skipped, count(*) FILTER (kind = 'ambiguous') AS ambiguous_links, count(*) FILTER (kind = 'missing') AS missing_links
FROM (FROM wk UNION ALL FROM mk)"""
)


def _unlinked() -> str:
    """Related notes of notes without wikilinks, by the same conventions."""
    from inkmesh.operators.rewrite import RELATED_HEADING, ROOT_HUBS, THEME_HUBS

    roots = ", ".join(f"'{h}'" for h in ROOT_HUBS)
    hubs = ", ".join(f"CASE WHEN starts_with(path, '{h}/') THEN '{h}/README' END" for h in THEME_HUBS)
    bare = "regexp_replace({0}, '\\.md$', '')"
    return (
        VAULT
        + f""", d AS (SELECT path, text, string_split(path, '/')[-1] AS name, {_FOLDER.replace("src", "path")} AS dir FROM v),
rd AS (SELECT DISTINCT dir FROM d WHERE name = 'README.md'),
sb AS (SELECT dir, list(path ORDER BY path)[1:3] AS sib FROM d WHERE name <> 'README.md' GROUP BY dir),
tt AS (SELECT {bare.format("path")} AS link, trim(list_filter(string_split(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10))[1:60], lambda x: starts_with(x, '# '))[1][3:], {_WS}) AS title FROM v),
bn AS (SELECT d.path, text, d.dir, {_FOLDER.replace("src", "d.dir")} AS up, list_filter(coalesce(sib, []), lambda x: x <> d.path) AS others FROM d LEFT JOIN sb ON sb.dir = d.dir WHERE name <> 'README.md' AND NOT contains(text, '[[')),
l1 AS (SELECT path, text, list_filter([CASE WHEN dir IN (SELECT dir FROM rd) THEN CASE WHEN dir = '' THEN 'README' ELSE dir || '/README' END END,
  CASE WHEN up IN (SELECT dir FROM rd) THEN CASE WHEN up = '' THEN 'README' ELSE up || '/README' END END, CASE WHEN string_split(path, '/')[1] IN ({roots}) THEN string_split(path, '/')[1] || '/README' END,
  {hubs}, {bare.format("others[2]")}, {bare.format("others[1]")}], lambda x: x IS NOT NULL) AS l FROM bn),
l2 AS (SELECT path, text, list_filter(l, lambda x, i: list_position(l, x) = i) AS l FROM l1),
l3 AS (SELECT path, text, CASE WHEN len(l) < 2 AND NOT list_contains(l, 'index') THEN list_append(l, 'index') ELSE l END AS l FROM l2),
l4 AS (SELECT path, text, (CASE WHEN len(l) < 2 AND NOT list_contains(l, 'README') THEN list_append(l, 'README') ELSE l END)[1:3] AS l FROM l3),
l5 AS (SELECT path, text, l[r] AS link, r FROM (SELECT path, text, l, unnest(range(1, len(l) + 1)) AS r FROM l4)),
l6 AS (SELECT path, any_value(text) AS text, string_agg('- [[' || l5.link || '|' || coalesce(title, replace(string_split(l5.link, '/')[-1], '-', ' ')) || ']]', chr(10) ORDER BY r) AS more FROM l5 LEFT JOIN tt ON tt.link = l5.link GROUP BY path)
SELECT path, sha256(text || CASE WHEN ends_with(text, chr(10)) THEN '' ELSE chr(10) END || CASE WHEN regexp_matches(text, '(?m)^{RELATED_HEADING}\\s*$') THEN '' ELSE chr(10) || '{RELATED_HEADING}' || chr(10) || chr(10) END || more || chr(10)) AS sha256 FROM l6"""
    )


SQL["fix_unlinked"] = _unlinked()
SQL["similar_notes"] = (
    RESOLVE
    + """, sz AS (SELECT path, count(*) AS n FROM nb GROUP BY path),
qs AS (SELECT DISTINCT path AS query FROM notes WHERE note_id % 100 = 0 AND deleted_at IS NULL AND path IN (SELECT path FROM v)),
ov AS (SELECT query, b.path, count(*) AS i FROM qs JOIN nb a ON a.path = query JOIN nb b ON b.nbr = a.nbr WHERE b.path <> query GROUP BY 1, 2),
sc AS (SELECT query, v.path, coalesce(round(i / (x.n + y.n - i), 6), 0) AS score FROM qs CROSS JOIN v LEFT JOIN ov USING (query, path) LEFT JOIN sz x ON x.path = query LEFT JOIN sz y ON y.path = v.path WHERE v.path <> query)
SELECT query, path, score FROM sc QUALIFY row_number() OVER (PARTITION BY query ORDER BY score DESC, path) <= 10"""
)
