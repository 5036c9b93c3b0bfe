"""Queries of the general training-data operators (problems 1 to 3 and 5 to 7) and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from arborlake.operators import drift, hierarchy, references, skew, twins
from arborlake.runtime import read_table as t
from arborlake.runtime import times_as_text
from arborlake.sources import csv_points

QUANTILES = [0.05, 0.25, 0.5, 0.75, 0.95]


def _texts(trees):
    """Paths as text, which every store and checker holds alike."""
    return trees.withColumn("path", F.array_join("path", "/"))


def queries() -> dict:
    return {
        "p1_found": lambda s, d: drift.schema_changes(t(s, d, "node_exports")).select("export_id", "change", "field", "new_field"),
        "p1_lifespans": lambda s, d: drift.column_lifespans(t(s, d, "node_exports")),
        "p1_casts": lambda s, d: drift.column_casts(t(s, d, "node_exports")),
        "p1_nodes": lambda s, d: times_as_text(drift.consistent_nodes(t(s, d, "node_exports")), "last_export"),
        "p2_found": lambda s, d: hierarchy.cyclic_nodes(t(s, d, "neurons")),
        "p2_trees": lambda s, d: _texts(hierarchy.hierarchies(t(s, d, "neurons"))),
        "p2_found_in_blocks": lambda s, d: hierarchy.cyclic_nodes(t(s, d, "neurons"), cap=500),
        "p2_trees_in_blocks": lambda s, d: _texts(hierarchy.hierarchies(t(s, d, "neurons"), cap=500)),
        "p2_descendants": lambda s, d: hierarchy.descendants(hierarchy.hierarchies(t(s, d, "neurons"), paths=False)),
        "p2_depths": lambda s, d: hierarchy.hierarchies(t(s, d, "neurons"), paths=False).where("cycle_node_id is null").select("file_id", "node_id", "root_id", "depth", "n_descendants"),
        "p3_found": lambda s, d: skew.key_loads(t(s, d, "neurons"), "file_id", "x").where("heavy").select("file_id"),
        "p3_loads": lambda s, d: skew.key_loads(t(s, d, "neurons"), "file_id", "x").select("file_id", "n_rows", "heavy"),
        "p3_quantiles": lambda s, d: skew.key_quantiles(t(s, d, "neurons"), "file_id", "x", QUANTILES),
        "p5_found": lambda s, d: references.orphans(t(s, d, "neurons"), t(s, d, "atlas_regions")).select("file_id", "node_id", "ref_field"),
        "p5_report": lambda s, d: references.orphan_report(t(s, d, "neurons"), t(s, d, "atlas_regions")),
        "p6_found": lambda s, d: twins.differences(t(s, d, "neurons"), t(s, d, "neurons_copy")).select("file_id", "node_id", "diff"),
        "p6_report": lambda s, d: twins.difference_report(t(s, d, "neurons"), t(s, d, "neurons_copy")),
        "p6_matrix": lambda s, d: twins.column_checksums(t(s, d, "neurons"), t(s, d, "neurons_copy")),
        "p7_found": lambda s, d: csv_points.bad_records(t(s, d, "point_csv_lines")).select("csv_file", "line_no", "reason"),
        "p7_points": lambda s, d: csv_points.good_points(t(s, d, "point_csv_lines")).drop("extras"),
    }


_NODES = "SELECT file_id, node_id, MIN(loaded_at) AS t, MIN(parent_id) AS p, MIN(region_id) AS r FROM neurons WHERE file_id IS NOT NULL AND node_id IS NOT NULL GROUP BY file_id, node_id"
_ORPHANS = f"""
SELECT a.file_id, a.node_id, 'parent_id' AS ref_field, a.t, CASE WHEN b.node_id IS NULL THEN 'missing' ELSE 'later' END AS cause
FROM n a LEFT JOIN n b ON a.file_id = b.file_id AND a.p = b.node_id
WHERE a.p IS NOT NULL AND a.p <> -1 AND (b.node_id IS NULL OR b.t > a.t)
UNION ALL
SELECT a.file_id, a.node_id, 'region_id', a.t, CASE WHEN EXISTS (SELECT 1 FROM atlas_regions g WHERE g.region_id = a.r) THEN 'not_valid' ELSE 'missing' END
FROM n a WHERE a.r IS NOT NULL AND a.r <> 0 AND NOT EXISTS (
  SELECT 1 FROM atlas_regions g WHERE g.region_id = a.r AND g.added_at <= a.t AND (g.retired_at IS NULL OR a.t < g.retired_at))"""
_SIDES = """
WITH a AS (SELECT file_id, node_id, MAX(CASE WHEN isnan(x) THEN NULL ELSE x END) AS x, COALESCE(MAX(region_id), 0) AS r FROM neurons GROUP BY file_id, node_id),
b AS (SELECT file_id, node_id, MAX(CASE WHEN isnan(x) THEN NULL ELSE x END) AS x, COALESCE(MAX(region_id), 0) AS r FROM neurons_copy GROUP BY file_id, node_id),
j AS (SELECT COALESCE(a.file_id, b.file_id) AS file_id, COALESCE(a.node_id, b.node_id) AS node_id, a.file_id IS NULL AS no_a, b.file_id IS NULL AS no_b,
  a.x AS ax, b.x AS bx, a.r AS ar, b.r AS br FROM a FULL JOIN b ON a.file_id = b.file_id AND a.node_id = b.node_id),
f AS (SELECT file_id, node_id, 'missing_in_copy' AS diff FROM j WHERE no_b
UNION ALL SELECT file_id, node_id, 'missing_in_neurons' FROM j WHERE no_a
UNION ALL SELECT file_id, node_id, 'region_id' FROM j WHERE NOT no_a AND NOT no_b AND ar <> br
UNION ALL SELECT file_id, node_id, 'x' FROM j WHERE NOT no_a AND NOT no_b AND (ABS(ax - bx) > 0.001 OR (ax IS NULL) <> (bx IS NULL)))
"""


_TREES = """WITH RECURSIVE n AS (SELECT file_id, node_id, MIN(parent_id) AS p FROM neurons WHERE file_id IS NOT NULL AND node_id IS NOT NULL GROUP BY 1, 2),
tops AS (SELECT a.file_id, a.node_id FROM n a LEFT JOIN n b ON a.file_id = b.file_id AND a.p = b.node_id AND a.p <> -1 WHERE b.node_id IS NULL),
fine AS (SELECT file_id, node_id, node_id AS root_id, 0 AS depth FROM tops
  UNION ALL SELECT c.file_id, c.node_id, f.root_id, f.depth + 1 FROM fine f JOIN n c ON c.file_id = f.file_id AND c.p = f.node_id AND c.p <> -1),
bad AS (SELECT n.* FROM n ANTI JOIN fine USING (file_id, node_id)),
walk AS (SELECT file_id, node_id, p AS cur FROM bad UNION SELECT w.file_id, w.node_id, b.p FROM walk w JOIN bad b ON b.file_id = w.file_id AND b.node_id = w.cur),
above AS (SELECT file_id, node_id, p AS cur FROM n SEMI JOIN fine USING (file_id, node_id) WHERE p <> -1 UNION ALL SELECT a.file_id, a.node_id, n.p FROM above a JOIN n ON n.file_id = a.file_id AND n.node_id = a.cur WHERE n.p <> -1)
"""


_LOOPS = """SELECT w.file_id, w.node_id, MIN(w.cur) AS cycle_node_id FROM walk w
  JOIN (SELECT DISTINCT file_id, cur FROM walk WHERE node_id = cur) l ON w.file_id = l.file_id AND w.cur = l.cur GROUP BY 1, 2"""
_WHOLE_TREES = _TREES.replace("0 AS depth FROM tops", "0 AS depth, [node_id] AS ids FROM tops").replace("f.depth + 1 FROM fine", "f.depth + 1, list_append(f.ids, c.node_id) FROM fine") + f""",
numbered AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY file_id, root_id ORDER BY ids) - 1 AS preorder FROM fine),
sizes AS (SELECT file_id, cur, COUNT(*) AS n FROM above GROUP BY 1, 2), loops AS ({_LOOPS})
SELECT f.file_id, f.node_id, COALESCE(n.p, -1) AS parent_id, f.root_id, f.depth, 2 * preorder - f.depth AS entry, 2 * preorder - f.depth + 2 * COALESCE(s.n, 0) + 1 AS exit, preorder, COALESCE(s.n, 0) AS n_descendants,
  CAST(NULL AS INT) AS cycle_node_id, array_to_string(ids, '/') AS path
FROM numbered f JOIN n USING (file_id, node_id) LEFT JOIN sizes s ON f.file_id = s.file_id AND f.node_id = s.cur
UNION ALL SELECT file_id, node_id, COALESCE(n.p, -1), NULL, NULL, NULL, NULL, NULL, NULL, cycle_node_id, NULL FROM loops JOIN n USING (file_id, node_id)"""


_FIELD = '(?:"(?:[^"]|"")*"|[^",]*)'
_NAMES = "CASE n WHEN 'marker' THEN 'label' WHEN 'atlas_x' THEN 'x' WHEN 'atlas_y' THEN 'y' WHEN 'atlas_z' THEN 'z' WHEN 'region_acronym' THEN 'acronym' WHEN 'region_id' THEN 'id' WHEN 'region_hemisphere' THEN 'hemisphere' ELSE n END"
_WHITE = "[\\s\\x{85}\\x{a0}\\x{1c}-\\x{1f}\\x{0b}\\p{Z}]"
_STRIPPED = lambda c: f"regexp_replace({c}, '^{_WHITE}+|{_WHITE}+$', '', 'g')"
_CSV = f"""WITH heads AS (SELECT csv_file, arg_max(raw, (COALESCE(received_at, TIMESTAMP '0001-01-01'), raw)) AS head FROM point_csv_lines WHERE line_no = 1 AND raw IS NOT NULL GROUP BY 1),
cut AS (SELECT l.csv_file, l.line_no, COALESCE(l.raw, '') AS raw, list_transform(regexp_extract_all(',' || replace(head, chr(65279), ''), ',({_FIELD})', 1), lambda h: trim(CASE WHEN h[1] = '"' THEN replace(h[2:-2], '""', '"') ELSE h END)) AS names,
  regexp_extract_all(',' || COALESCE(l.raw, ''), ',({_FIELD})', 1) AS cells, regexp_full_match(COALESCE(l.raw, ''), '(?s){_FIELD}(?:,{_FIELD})*') AS quoted_well FROM point_csv_lines l LEFT JOIN heads USING (csv_file) WHERE line_no IS DISTINCT FROM 1),
named AS (SELECT csv_file, line_no, quoted_well, len(cells) = len(names) AS counted, list_transform(names, lambda n: {_NAMES}) AS names, list_transform(cells, lambda c: CASE WHEN c[1] = '"' THEN replace(c[2:-2], '""', '"') ELSE c END) AS cells FROM cut),
fields AS (SELECT *, {', '.join(f"cells[list_position(names, '{c}')] AS {c}" for c in csv_points.COLUMNS)} FROM named),
bad AS (SELECT *, COALESCE({_STRIPPED('label')}, '') = '' AS no_label, {' OR '.join(f"NOT COALESCE(regexp_full_match(trim({c}, chr(32) || chr(9)), '[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?') AND isfinite(TRY_CAST(trim({c}, chr(32) || chr(9)) AS DOUBLE)), FALSE)" for c in 'xyz')} AS no_number,
  COALESCE({_STRIPPED('id')}, '') <> '' AND NOT regexp_full_match({_STRIPPED('id')}, '[+-]?[0-9]+') AS no_id, COALESCE(regexp_matches(region_name, '[\\x{{00}}-\\x{{1f}}\\x{{7f}}-\\x{{9f}}\\x{{fffd}}]'), FALSE) AS no_name FROM fields),
judged AS (SELECT *, CASE WHEN NOT quoted_well THEN 'bad_quoting' WHEN NOT counted THEN 'column_count' WHEN no_label OR no_number OR no_id OR no_name THEN 'invalid_value' END AS reason FROM bad)"""
_TYPED = {"int": "n", "double": "d", "boolean": "b", "string": "v"}
_PLAIN = lambda c: f"NULLIF({_STRIPPED(c)}, '') AS {c}"
CSV_POINTS = f"""{_CSV}, points AS (SELECT {_STRIPPED('label')} AS label, {', '.join(f'CAST(trim({c}, chr(32) || chr(9)) AS DOUBLE) AS {c}' for c in 'xyz')}, {_PLAIN('region_name')}, {_PLAIN('acronym')}, TRY_CAST({_STRIPPED('id')} AS BIGINT) AS id, {_PLAIN('hemisphere')}, csv_file AS origin_csv, line_no FROM judged WHERE reason IS NULL)"""
_FIELDS = """WITH lines AS (SELECT stream, export_id, exported_at, payload FROM node_exports WHERE stream IS NOT NULL AND export_id IS NOT NULL AND json_valid(payload) AND json_type(payload) = 'OBJECT'),
exports AS (SELECT stream, export_id, ROW_NUMBER() OVER (PARTITION BY stream ORDER BY MIN(exported_at), export_id) AS seq FROM node_exports WHERE stream IS NOT NULL AND export_id IS NOT NULL GROUP BY 1, 2),
f AS (SELECT stream, export_id, payload ->> 'file_id' AS file_id, payload ->> 'node_id' AS node_id, k AS field, json_type(payload, '$."' || k || '"') AS t, payload ->> ('$."' || k || '"') AS v FROM (SELECT *, unnest(json_keys(payload)) AS k FROM lines)),
kinds AS (SELECT f.*, seq, CASE WHEN t = 'NULL' THEN NULL WHEN t = 'BOOLEAN' THEN 'boolean' WHEN t IN ('BIGINT', 'UBIGINT', 'HUGEINT') THEN 'integer' WHEN t = 'DOUBLE' THEN 'decimal' ELSE 'text' END AS kind FROM f JOIN exports USING (stream, export_id)),
cat AS (SELECT stream, export_id, seq, field, CASE WHEN bool_or(kind = 'text') OR (bool_or(kind = 'boolean') AND bool_or(kind IN ('integer', 'decimal'))) THEN 'text' WHEN bool_or(kind = 'boolean') THEN 'boolean' WHEN bool_or(kind = 'decimal') THEN 'decimal' WHEN bool_or(kind = 'integer') THEN 'integer' END AS type FROM kinds GROUP BY ALL)"""
_CHANGES = _FIELDS + """, added AS (SELECT a.stream, a.seq, a.field FROM cat a ANTI JOIN cat b ON a.stream = b.stream AND a.seq = b.seq + 1 AND a.field = b.field WHERE a.seq > 1),
gone AS (SELECT a.stream, a.seq + 1 AS seq, a.field FROM cat a ANTI JOIN cat b ON a.stream = b.stream AND a.seq = b.seq - 1 AND a.field = b.field SEMI JOIN exports e ON e.stream = a.stream AND e.seq = a.seq + 1),
vals AS (SELECT DISTINCT stream, seq, file_id, node_id, field, v FROM kinds WHERE v IS NOT NULL), nodes AS (SELECT DISTINCT stream, seq, file_id, node_id FROM kinds),
held AS (SELECT v.stream, v.seq + s.step AS seq, v.field, s.step, list((v.file_id, v.node_id, v.v) ORDER BY v.file_id, v.node_id, v.v) AS all_ FROM vals v CROSS JOIN (VALUES (0), (1)) s(step)
  SEMI JOIN nodes o ON o.stream = v.stream AND o.seq = v.seq + (2 * s.step - 1) AND o.file_id IS NOT DISTINCT FROM v.file_id AND o.node_id IS NOT DISTINCT FROM v.node_id GROUP BY 1, 2, 3, 4),
old AS (SELECT h.*, ROW_NUMBER() OVER (PARTITION BY h.stream, h.seq, all_ ORDER BY h.field) AS n FROM held h SEMI JOIN gone g ON g.stream = h.stream AND g.seq = h.seq AND g.field = h.field WHERE step = 1),
new AS (SELECT h.*, ROW_NUMBER() OVER (PARTITION BY h.stream, h.seq, all_ ORDER BY h.field) AS n FROM held h SEMI JOIN added g ON g.stream = h.stream AND g.seq = h.seq AND g.field = h.field WHERE step = 0),
moved AS (SELECT o.stream, o.seq, o.field, w.field AS new_field FROM old o JOIN new w ON o.stream = w.stream AND o.seq = w.seq AND o.all_ = w.all_ AND o.n = w.n),
found AS (SELECT stream, seq, 'renamed' AS change, field, new_field FROM moved
UNION ALL SELECT stream, seq, 'added', field, '' FROM added a ANTI JOIN moved m ON a.stream = m.stream AND a.seq = m.seq AND a.field = m.new_field
UNION ALL SELECT stream, seq, 'removed', field, '' FROM gone a ANTI JOIN moved m ON a.stream = m.stream AND a.seq = m.seq AND a.field = m.field
UNION ALL SELECT a.stream, a.seq, 'retyped', a.field, '' FROM cat a JOIN cat b ON a.stream = b.stream AND a.seq = b.seq + 1 AND a.field = b.field WHERE a.type <> b.type)"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": _CHANGES + "SELECT export_id, change, field, new_field FROM found JOIN exports USING (stream, seq)",
        "p1_lifespans": _FIELDS + """, carried AS (SELECT * REPLACE (COALESCE(type, last_value(type IGNORE NULLS) OVER (PARTITION BY stream, field ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS type) FROM cat),
            marked AS (SELECT *, CASE WHEN LAG(seq) OVER w = seq - 1 AND LAG(type) OVER w IS NOT DISTINCT FROM type THEN 0 ELSE 1 END AS new FROM carried WINDOW w AS (PARTITION BY stream, field ORDER BY seq)),
            numbered AS (SELECT *, SUM(new) OVER (PARTITION BY stream, field ORDER BY seq) AS island FROM marked)
            SELECT stream, field, type, CAST(MIN(seq) AS INT) AS first_seq, CAST(MAX(seq) AS INT) AS last_seq, arg_min(export_id, seq) AS first_export, arg_max(export_id, seq) AS last_export, COUNT(*) AS n_exports FROM numbered GROUP BY stream, field, island, type""",
        "p1_nodes": _FIELDS + """, alias(plain, target) AS (VALUES """ + ", ".join(f"('{a}', '{c}')" for a, c in drift.ALIASES.items()) + """),
            typed AS (SELECT k.file_id, TRY_CAST(k.node_id AS BIGINT) AS node_id, CASE WHEN field IN ('type', 'x') THEN field ELSE target END AS target, v, l.exported_at, k.export_id FROM kinds k JOIN (SELECT DISTINCT stream, export_id, exported_at FROM lines) l USING (stream, export_id) LEFT JOIN alias ON plain = regexp_replace(lower(field), '[^a-z0-9]', '', 'g') WHERE k.file_id IS NOT NULL AND TRY_CAST(k.node_id AS BIGINT) IS NOT NULL),
            cast_ AS (SELECT *, TRY_CAST(v AS DOUBLE) AS d, CASE WHEN TRY_CAST(v AS DOUBLE) = ROUND_EVEN(TRY_CAST(v AS DOUBLE), 0) THEN TRY_CAST(TRY_CAST(v AS DOUBLE) AS INT) END AS n, TRY_CAST(v AS BOOLEAN) AS b FROM typed)
            SELECT file_id, node_id, """ + ", ".join(f"arg_max({_TYPED[k]}, (exported_at, export_id, v)) FILTER (target = '{c}' AND {_TYPED[k]} IS NOT NULL) AS {c}" for c, k in ({"type": "int", "x": "double"} | drift.TARGETS).items()) + """, strftime(MAX(exported_at), '%Y-%m-%d %H:%M:%S.%f') AS last_export FROM cast_ GROUP BY 1, 2""",
        "p1_casts": _FIELDS + """, named AS (SELECT field, type, COUNT(*) AS n_exports, regexp_replace(lower(field), '[^a-z0-9]', '', 'g') AS plain FROM cat GROUP BY 1, 2),
            alias(plain, column_name) AS (VALUES """ + ", ".join(f"('{a}', '{c}')" for a, c in drift.ALIASES.items()) + """), target(column_name, column_type) AS (VALUES """ + ", ".join(f"('{a}', '{c}')" for a, c in drift.TARGETS.items()) + """)
            SELECT field, type, n_exports, column_name, column_type, 'try_cast(`' || field || '` AS ' || column_type || ') AS ' || column_name AS cast_sql FROM named LEFT JOIN alias USING (plain) LEFT JOIN target USING (column_name)""",
        "p7_points": CSV_POINTS + " SELECT * FROM points",
        "p7_found": _CSV + " SELECT csv_file, line_no, reason FROM judged WHERE reason IS NOT NULL",
        "p2_found": _TREES + _LOOPS,
        "p2_found_in_blocks": _TREES + _LOOPS,
        "p2_trees": _WHOLE_TREES,
        "p2_trees_in_blocks": _WHOLE_TREES,
        "p2_descendants": _TREES + "SELECT a.file_id, cur AS node_id, a.node_id AS descendant_id FROM above a SEMI JOIN n ON a.file_id = n.file_id AND a.cur = n.node_id",
        "p2_depths": _TREES + """SELECT f.file_id, f.node_id, f.root_id, f.depth, COALESCE(c.n, 0) AS n_descendants FROM fine f
            LEFT JOIN (SELECT file_id, cur, COUNT(*) AS n FROM above GROUP BY 1, 2) c ON f.file_id = c.file_id AND f.node_id = c.cur""",
        "p3_found": "SELECT file_id FROM neurons GROUP BY file_id HAVING COUNT(*) >= 0.02 * (SELECT COUNT(*) FROM neurons)",
        "p3_loads": "SELECT file_id, COUNT(*) AS n_rows, COUNT(*) >= 0.02 * (SELECT COUNT(*) FROM neurons) AS heavy FROM neurons GROUP BY file_id",
        "p3_quantiles": "\nUNION ALL\n".join(
            f"SELECT file_id, CAST({p} AS DOUBLE) AS prob, COUNT(*) AS n_values, QUANTILE_DISC(x, {p}) AS value FROM neurons WHERE x IS NOT NULL AND NOT isnan(x) GROUP BY file_id" for p in QUANTILES
        ),
        "p5_found": f"WITH n AS ({_NODES}) SELECT file_id, node_id, ref_field FROM ({_ORPHANS}) o",
        "p5_report": f"""WITH n AS ({_NODES}) SELECT CASE ref_field WHEN 'parent_id' THEN 'neurons' ELSE 'atlas_regions' END AS referred_table, cause, strftime(t, '%Y-%m') AS load_month,
            COUNT(*) AS n_orphans, COUNT(DISTINCT file_id) AS n_files FROM ({_ORPHANS}) o GROUP BY 1, 2, 3""",
        "p6_found": _SIDES + "SELECT file_id, node_id, diff FROM f",
        "p6_matrix": """WITH rows_ AS (SELECT 0 AS side, file_id, node_id, x, region_id FROM neurons UNION ALL SELECT 1, file_id, node_id, x, region_id FROM neurons_copy),
            h AS (SELECT side, file_id, CAST(FLOOR(node_id / 8.0) AS BIGINT) AS b, node_id, COALESCE(region_id, 0) AS r, CASE WHEN x IS NULL OR isnan(x) THEN '' WHEN ABS(x) < 1e12 AND ABS(x - ROUND_EVEN(x / 0.01, 0) * 0.01) <= 0.0005 THEN CAST(ROUND_EVEN(x / 0.01, 0) AS VARCHAR) ELSE side || ' ' || x END AS v FROM rows_ WHERE file_id IS NOT NULL AND node_id IS NOT NULL),
            l AS (SELECT file_id, b, """ + ", ".join(f"COALESCE(list({v} ORDER BY {v}) FILTER (side = 0 AND {w}), []) <> COALESCE(list({v} ORDER BY {v}) FILTER (side = 1 AND {w}), []) AS {n}" for n, v, w in (("k", "node_id", "TRUE"), ("g", "(node_id, r)", "TRUE"), ("x", "(node_id, v)", "v <> ''"))) + """ FROM h GROUP BY 1, 2)
            SELECT file_id, COUNT(*) AS n_buckets, COUNT(*) FILTER (k) AS unequal_keys, COUNT(*) FILTER (g) AS unequal_region_id, COUNT(*) FILTER (x) AS unequal_x FROM l GROUP BY 1""",
        "p6_report": _SIDES + "SELECT diff, COUNT(*) AS n_nodes, COUNT(DISTINCT file_id) AS n_files FROM f GROUP BY diff",
    }
