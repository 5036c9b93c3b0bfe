"""The general training-data operators against brute force and on awkward input."""

import json
import math
import random
from collections import defaultdict
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from arborlake.operators import drift, hierarchy, references, skew, twins
from arborlake.runtime import read_table
from arborlake.sources import csv_points

T0 = datetime(2025, 1, 1)
NEURON = "file_id string, node_id int, parent_id int, region_id int, x double, y double, z double, loaded_at timestamp, n int, key string, _f string, bucket long"


def neuron(file, node, parent=-1, region=0, x=1.0, y=1.0, z=1.0, day=0):
    return (file, node, parent, region, x, y, z, T0 + timedelta(days=day) if day is not None else None, 7, "k", "f", 3)


def neurons(spark, rows):
    return spark.createDataFrame(rows, NEURON)


# 1 -----------------------------------------------------------------------------------------------


def brute_changes(lines):
    """Each export against the one before it, by plain Python."""
    exports = defaultdict(dict)
    for stream, export, at, payload in lines:
        try:
            row = json.loads(payload, parse_int=lambda v: ("i", v), parse_float=lambda v: ("d", v))
        except (TypeError, ValueError):
            row = None
        got = exports[stream].setdefault((at, export), [])
        if isinstance(row, dict):
            got.append(row)
    kind = lambda v: "boolean" if isinstance(v, bool) else {"i": "integer", "d": "decimal"}[v[0]] if isinstance(v, tuple) else "text"
    plain = lambda v: v[1] if isinstance(v, tuple) else v
    out = set()
    for by in exports.values():
        before = None
        for (_, export), rows in sorted(by.items()):
            names = {n for r in rows for n in r}
            kinds = {}
            for n in names:
                k = {kind(r[n]) for r in rows if r.get(n) is not None}
                kinds[n] = None if not k else k.pop() if len(k) == 1 else "decimal" if k == {"integer", "decimal"} else "text"
            nodes = {(plain(r["file_id"]), plain(r["node_id"])): r for r in rows}
            if before is not None:
                old_names, old_kinds, old_nodes = before
                gone, new = old_names - names, names - old_names
                both = old_nodes.keys() & nodes.keys()
                for g in sorted(gone):
                    for w in sorted(new):
                        a, b = ([plain(s[k].get(n)) for k in sorted(both)] for s, n in ((old_nodes, g), (nodes, w)))
                        if a == b and any(v is not None for v in a) and g in gone and w in new:
                            out.add((export, "renamed", g, w))
                            gone, new = gone - {g}, new - {w}
                out |= {(export, "added", n, "") for n in new} | {(export, "removed", n, "") for n in gone}
                out |= {(export, "retyped", n, "") for n in names & old_names if kinds[n] and old_kinds[n] and kinds[n] != old_kinds[n]}
            before = names, kinds, nodes
    return out


def changes(df):
    return {(r["export_id"], r["change"], r["field"], r["new_field"]) for r in drift.schema_changes(df).collect()}


def test_schema_changes_equal_brute_force(spark, sf):
    for folder in (sf,):
        df = read_table(spark, folder, "node_exports")
        lines = [(r["stream"], r["export_id"], r["exported_at"], r["payload"]) for r in df.collect()]
        want = brute_changes(lines)
        assert changes(df) == want
        assert want


LINES = "stream string, export_id long, exported_at timestamp, received_at timestamp, line_no int, payload string, seq int, field string"


def test_schema_changes_awkward(spark):
    def line(export, day, payload, stream="s"):
        return (stream, export, T0 + timedelta(days=day), T0, 1, payload, 1, "x")

    p = lambda **kw: json.dumps({"file_id": "f", "node_id": kw.pop("node", 1), **kw})
    df = spark.createDataFrame(
        [
            line(1, 0, p(a=1, b="t", c=None)), line(1, 0, p(a=1, b="t", c=None)), line(1, 0, p(node=2, a=None)),
            line(2, 1, p(a2=1, b="t", C=None)), line(2, 1, p(node=2, a2=None, b="é" * 50_000)), line(2, 1, "no json"), line(2, 1, None), line(2, 1, "[1]"),
            line(3, 2, p(a2="1", b="t", C=None)), line(None, 2, p(a=1)), line(4, 1, p(a=1), None),
        ],
        LINES,
    )
    assert changes(df) == {(2, "renamed", "a", "a2"), (2, "removed", "c", ""), (2, "added", "C", ""), (3, "retyped", "a2", "")}
    assert changes(df.limit(0)) == set()
    spans = {(r["field"], r["type"]): (r["first_seq"], r["last_seq"]) for r in drift.column_lifespans(df.where("stream = 's' and export_id is not null")).collect()}
    assert spans[("a2", "integer")] == (2, 2) and spans[("a2", "text")] == (3, 3)


def test_kinds_of_numbers(spark):
    forms = {"18": "integer", "18.0": "decimal", "1.8e1": "decimal", "12345678901234567890": "integer", "12345678901234567890.0": "decimal", '"18"': "text", "true": "boolean", "null": None, "-0.50": "decimal", '{"a":1}': "text"}
    rows = [("s", 1, T0, T0, n, f'{{"file_id":"f","node_id":{n},"v{n}":{v}}}', 1, "") for n, v in enumerate(forms)]
    got = {r["field"]: (r["kind"], r["value"]) for r in drift.export_fields(spark.createDataFrame(rows, LINES)).collect()}
    assert [got[f"v{n}"][0] for n in range(len(forms))] == list(forms.values())
    assert got["v0"][1] == "18" and got["v1"][1] == got["v2"][1] == "18.0" and got["v8"][1] == "-0.5"
    casts = {r["field"]: r["cast_sql"] for r in drift.column_casts(spark.createDataFrame([("s", 1, T0, T0, 1, '{"clusterId":1,"odd":2}', 1, "")], LINES)).collect()}
    assert casts == {"clusterId": "try_cast(`clusterId` AS int) AS cluster_id", "odd": None}


def test_consistent_nodes_takes_latest_value_and_casts(spark):
    rows = [
        ("s", 1, T0, T0, 1, '{"file_id":"f","node_id":1,"x":1.5,"x_flat":0.5,"clusterId":3}', 1, ""),
        ("s", 2, T0 + timedelta(days=1), T0, 1, '{"node_id":1,"file_id":"f","X_Flat":"0.75","cluster_id":"no number"}', 1, ""),
    ]
    got = drift.consistent_nodes(spark.createDataFrame(rows, LINES)).first()
    assert (got["x"], got["x_flat"], got["cluster_id"]) == (1.5, 0.75, 3)


def test_consistent_nodes_takes_whole_decimals_as_integers(spark):
    forms = {1: "18.0", 2: '"18.0"', 3: "1.8e1", 4: '" 18.0 "', 5: "18", 6: "18.5", 7: "3e9", 8: '"NaN"', 9: '"Infinity"', 10: "null", 11: "-2147483648.0", 12: "2147483647.0", 13: "2147483648.0"}
    rows = [("s", 1, T0, T0, n, f'{{"file_id":"f","node_id":{n},"type":{v},"cluster_id":{v},"clusterAssignment":{v}}}', 1, "") for n, v in forms.items()]
    want = {n: 18 for n in range(1, 6)} | {n: None for n in (6, 7, 8, 9, 10, 13)} | {11: -(2**31), 12: 2**31 - 1}
    for c in ("type", "cluster_id", "cluster_assignment"):
        assert {r["node_id"]: r[c] for r in drift.consistent_nodes(spark.createDataFrame(rows, LINES)).collect()} == want


def test_consistent_nodes_keep_the_latest_of_decimal_and_integer(spark):
    rows = [("s", k, T0 + timedelta(days=k), T0, 1, f'{{"file_id":"f","node_id":1,"cluster_id":{v}}}', 1, "") for k, v in enumerate(("3", "4.0", "4.5"))]
    assert drift.consistent_nodes(spark.createDataFrame(rows, LINES)).first()["cluster_id"] == 4


# 2 -----------------------------------------------------------------------------------------------


def brute_trees(rows):
    """Path from the root of each node, or the least node of the loop it ends in."""
    parent = {}
    for f, n, p in rows:
        if f is not None and n is not None:
            old = parent.get((f, n))
            parent[f, n] = p if old is None else min(x for x in (old, p) if x is not None) if p is not None else old
    out = {}
    for f, n in parent:
        path, seen, at = [], {}, n
        while at is not None and at not in seen:
            seen[at] = len(path)
            path.append(at)
            up = parent[f, at]
            at = up if up is not None and up != -1 and (f, up) in parent else None
        out[f, n] = path[::-1] if at is None else min(path[seen[at] :])
    return out


def forest(seed, files=4, most=70, order="mixed"):
    rng, rows = random.Random(seed), []
    for f in range(files):
        ids = rng.sample(range(-50, 4 * most), rng.randint(1, most))
        if order == "sorted":
            ids.sort()
        for k, n in enumerate(ids):
            if n == -1:
                continue
            p = rng.random()
            parent = -1 if k == 0 or p < 0.05 else None if p < 0.08 else rng.choice(ids) if p < 0.13 else 9999 if p < 0.15 else ids[max(0, k - rng.randint(1, 3))]
            rows += [(f"f{f}", n, parent)] * (1 + (p > 0.9))
    return rows


@pytest.mark.parametrize("cap", [10_000, 25])
def test_hierarchies_equal_brute_force(spark, cap):
    rows = forest(cap) + [(None, 1, -1), ("f0", None, 1)]
    want = brute_trees(rows)
    df = neurons(spark, [neuron(f, n, p) for f, n, p in rows])
    loops = {k: v for k, v in want.items() if isinstance(v, int)}
    assert {(r[0], r[1]): r[2] for r in hierarchy.cyclic_nodes(df, cap).collect()} == loops
    trees = hierarchy.hierarchies(df, cap).cache()
    got = {(r["file_id"], r["node_id"]): r for r in trees.collect()}
    assert got.keys() == want.keys()
    below = defaultdict(set)
    for (f, n), path in want.items():
        if isinstance(path, list):
            for a in path[:-1]:
                below[f, a].add(n)
    for k, r in got.items():
        if k in loops:
            assert r["cycle_node_id"] == loops[k] and r["path"] is None and r["depth"] is None
        else:
            assert r["preorder"] == sum(want[o] < want[k] for o in want if o[0] == k[0] and isinstance(want[o], list) and want[o][0] == want[k][0])
            assert r["entry"] == 2 * r["preorder"] - r["depth"] and r["exit"] == r["entry"] + 2 * r["n_descendants"] + 1
            assert r["path"] == want[k] and r["depth"] == len(want[k]) - 1 and r["root_id"] == want[k][0] and r["n_descendants"] == len(below[k])
    chosen = sorted(k for k, v in below.items() if v)[:5]
    some = spark.createDataFrame(chosen, "file_id string, node_id int")
    picked = defaultdict(set)
    for r in hierarchy.descendants(trees, some).collect():
        picked[r[0], r[1]].add(r[2])
    assert picked == {k: below[k] for k in chosen}
    assert hierarchy.descendants(trees).count() == sum(map(len, below.values()))


def test_links_without_order_fall_back_to_jumps(spark):
    rng = random.Random(3)
    ids = list(range(120))
    rng.shuffle(ids)
    rows = [("one", n, ids[k - 1] if k else -1) for k, n in enumerate(ids)] + [("loop", n, ids[(k + 1) % 80]) for k, n in enumerate(ids[:80])]
    df = neurons(spark, [neuron(*r) for r in rows])
    got = {(r["file_id"], r["node_id"]): r for r in hierarchy.hierarchies(df, 10).collect()}
    assert all(got["one", n]["depth"] == k for k, n in enumerate(ids))
    assert {got["loop", n]["cycle_node_id"] for n in ids[:80]} == {min(ids[:80])}


def test_hierarchies_of_nothing(spark):
    assert hierarchy.hierarchies(neurons(spark, [])).count() == 0 and hierarchy.cyclic_nodes(neurons(spark, [])).count() == 0


# 3 -----------------------------------------------------------------------------------------------


def test_key_loads_and_heavy_keys(spark):
    rows = [("a",)] * 96 + [("b",)] * 2 + [("c",)] + [(None,)]
    table = "file_id string, x double, k string, cell long, c long, least double"
    given = [(k, [1.5, -2.0, None, math.nan, math.inf][n % 5], "k", 1, 1, 0.0) for n, (k,) in enumerate(rows)]
    got = {r["file_id"]: (r["n_rows"], r["heavy"]) for r in skew.key_loads(spark.createDataFrame(given, table), "file_id", "x").collect()}
    assert got == {"a": (96, True), "b": (2, True), "c": (1, False), None: (1, False)}
    assert skew.key_loads(spark.createDataFrame([], table), "file_id", "x").count() == 0 and skew.key_quantiles(spark.createDataFrame([], table), "file_id", "x", [0.5]).count() == 0


@pytest.mark.parametrize("bins", [2, 8, 512])
def test_quantiles_equal_brute_force(spark, bins):
    rng = random.Random(bins)
    data = {"hot": [rng.choice([rng.gauss(0, 1e6), rng.random(), 5.0, -0.0, 1e300, -1e300, 5e-324, 7 + rng.random() / 1e6]) for _ in range(400)], "same": [2.0] * 60, "one": [1.5], None: [3.0, 1.0, 2.0]}
    rows = [(k, v) for k, vs in data.items() for v in vs] + [("hot", None), ("hot", math.nan), ("hot", math.inf), ("bare", None)]
    probs = [0.0, 0.01, 0.5, 0.77, 1.0]
    got = {(r["file_id"], r["prob"]): (r["n_values"], r["value"]) for r in skew.key_quantiles(spark.createDataFrame(rows, "file_id string, x double"), "file_id", "x", probs, bins).collect()}
    want = {(k, p): (len(v), sorted(v)[max(1, math.ceil(p * len(v))) - 1]) for k, v in data.items() for p in probs}
    assert got == want


# 5 -----------------------------------------------------------------------------------------------

REGIONS = "region_id int, acronym string, added_at timestamp, retired_at timestamp, file_id string"


@pytest.mark.parametrize("block", [4, 1 << 15])
def test_orphans_equal_brute_force(spark, block):
    rng = random.Random(block)
    rows = [neuron(f"f{rng.randint(0, 3)}", rng.randint(-20, 60), rng.choice([-1, None, rng.randint(-20, 70)]), rng.choice([0, None, 1, 2, 3, 4]), day=rng.randint(0, 9)) for _ in range(300)]
    first = {}
    for f, n, p, g, *_, t, _, _, _, _ in rows:
        a = first.setdefault((f, n), [t, p, g])
        a[0] = min(a[0], t)
        a[1] = min((v for v in (a[1], p) if v is not None), default=None)
        a[2] = min((v for v in (a[2], g) if v is not None), default=None)
    regions = [(1, "a", T0, None, "f"), (2, "b", T0 + timedelta(days=3), T0 + timedelta(days=6), "f"), (3, "c", T0 - timedelta(days=9), T0, "f"), (None, "d", T0, None, "f")]
    want = set()
    for (f, n), (t, p, g) in first.items():
        if p not in (None, -1) and ((f, p) not in first or first[f, p][0] > t):
            want.add((f, n, "parent_id"))
        if g not in (None, 0) and not any(r == g and a <= t and (z is None or t < z) for r, _, a, z, _ in regions):
            want.add((f, n, "region_id"))
    df = neurons(spark, rows + [neuron(None, 1, 2, 9), neuron("f0", None, 2, 9)])
    got = references.orphans(df, spark.createDataFrame(regions, REGIONS), block)
    assert {(r["file_id"], r["node_id"], r["ref_field"]) for r in got.collect()} == want
    assert got.count() == len(want)
    report = references.orphan_report(df, spark.createDataFrame(regions, REGIONS))
    assert report.agg(F.sum("n_orphans")).first()[0] == len(want)
    assert references.orphans(df.limit(0), spark.createDataFrame([], REGIONS)).count() == 0


# 6 -----------------------------------------------------------------------------------------------


def test_differences_equal_brute_force(spark):
    rng = random.Random(1)
    a, b = [], []
    for k in range(600):
        f, n, x, g = f"f{k % 4}", k // 4, rng.choice([None, math.nan, round(rng.uniform(-9000, 9000), 2), rng.uniform(-1, 1), math.inf, 1e13]), rng.choice([None, 0, 5, 6])
        if rng.random() < 0.95:
            a += [(f, n, x, g)] * rng.choice([1, 1, 1, 3])
        if rng.random() < 0.95:
            shift = rng.choice([0.0, 0.0, 0.0004, -0.0009, 0.0015, 5.0])
            y = x + shift if x is not None and not math.isnan(x) else rng.choice([None, math.nan, x])
            b += [(f, n, y if rng.random() < 0.9 else None, g if rng.random() < 0.9 else rng.choice([0, None, 7]))] * rng.choice([1, 1, 2])
    a += [("F0", 1, 1.0, 5), ("f0", None, 1.0, 1)]
    b += [("f0 ", 1, 1.0, 5), (None, 1, 1.0, 1)]
    rng.shuffle(b)
    table = lambda rows: {(f, n): (None if x is None or math.isnan(x) else x, g or 0) for f, n, x, g in rows if f is not None and n is not None}
    one, two, want = table(a), table(b), set()
    for k in one.keys() | two.keys():
        if k not in two:
            want.add((*k, "missing_in_copy"))
        elif k not in one:
            want.add((*k, "missing_in_neurons"))
        else:
            (x, g), (y, h) = one[k], two[k]
            if g != h:
                want.add((*k, "region_id"))
            if (x is None) != (y is None) or x is not None and not (x == y or abs(x - y) <= 0.001):
                want.add((*k, "x"))
    schema = "file_id string, node_id int, x double, region_id int"
    got = twins.differences(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema))
    assert {(r["file_id"], r["node_id"], r["diff"]) for r in got.collect()} == want
    by_file = {r["file_id"]: r for r in twins.column_checksums(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema)).collect()}
    assert set(by_file) == {f for f, n, *_ in a + b if f is not None and n is not None} and by_file["F0"]["unequal_keys"] == by_file["F0"]["n_buckets"] == 1
    assert all(r["unequal_keys"] <= r["unequal_region_id"] <= r["n_buckets"] and r["unequal_x"] <= r["n_buckets"] for r in by_file.values())
    empty = spark.createDataFrame([], schema)
    assert twins.differences(empty, empty).count() == 0
    assert twins.differences(empty, spark.createDataFrame(b, schema)).where("diff <> 'missing_in_neurons'").count() == 0


# 7 -----------------------------------------------------------------------------------------------


def test_records_are_parsed_and_errors_located():
    columns = ["label", "x", "y", "z", "region_name", "id"]
    check = lambda raw: csv_points.parse_record(raw, columns)[1:]
    good = ['a,1,2,3,,', '"d, e",1e3,+.5,-2.,"say ""x""",7', "a, 1 ,2\t,3,Grenzfläche, 12 ", 'a,1,2,3,"",']
    assert [check(g)[0] for g in good] == [None] * 4
    assert csv_points.parse_record(good[1], columns)[0]["region_name"] == 'say "x"'
    for raw, at in (('a,1,2,3,"x,', 8), ('a,1,2,3,b"c,', 9), ('a, "1",2,3,,', 3), ('"a" ,1,2,3,,', 2), ('"a"b",1,2,3,,', 2), ('"', 0)):
        assert check(raw)[:2] == ("bad_quoting", at), raw
    for raw in ("a,1,2,3,", "a,1,2,3,,,", "", None, "a;1;2;3;;"):
        assert check(raw)[0] == "column_count", raw
    for raw, field in ((" ,1,2,3,,", "label"), ("a,1e999,2,3,,", "x"), ("a,,2,3,,", "x"), ("a,1,٣,3,,", "y"), ("a,1,2,0x1,,", "z"), ("a,1,2,nan,,", "z"), ("a,1,2,1_0,,", "z"), ("a,1,2,3,,3.7", "id"), ("a,1,2,3,b\tc,", "region_name"), ("a,1,2,3,�,", "region_name")):
        assert check(raw)[0] == "invalid_value" and check(raw)[2] == field, raw


def test_point_lines(spark, sf):
    schema = "csv_file string, line_no int, raw string, received_at timestamp, header string, reason string"
    rows = [
        ("a", 1, 'marker,"atlas_x",atlas_y,atlas_z,strength', T0, "h", "r"), ("a", 2, "m,1,2,3,0.5", T0, "h", "r"), ("a", 2, "m,1,2,3,0.5", T0, "h", "r"), ("a", 3, None, T0, "h", "r"), ("a", 4, "m,1,2,3," + "é" * 100_000, T0, "h", "r"),
        ("a", 1, "label,other", None, "h", "r"), ("c", 1, "label,x,y,z,id", None, "h", "r"), ("c", 2, "p,1,2,3," + "9" * 5000, T0, "h", "r"), ("c", 3, "p,1,2,3,-9223372036854775808", T0, "h", "r"), ("c", 4, "ö,1,2,3,9223372036854775808", T0, "h", "r"),
        ("b", 2, "no header,1", T0, "h", "r"), (None, 2, "x", T0, "h", "r"), ("a", None, "m,1,2", T0, "h", "r"),
    ]
    df = spark.createDataFrame(rows, schema)
    good = csv_points.good_points(df).collect()
    assert sorted((r["label"], r["x"], r["line_no"]) for r in good if r["origin_csv"] == "a") == [("m", 1.0, 2), ("m", 1.0, 2), ("m", 1.0, 4)]
    assert {r["line_no"]: (r["id"], r["extras"]) for r in good if r["origin_csv"] == "c"} == {2: (None, '{"id":"' + "9" * 5000 + '"}'), 3: (-(2**63), None), 4: (None, '{"id":"9223372036854775808"}')}
    assert len(csv_points.bad_records(df).collect()) == 4
    assert csv_points.parse_point_lines(df.limit(0)).count() == 0
    real = read_table(spark, sf, "point_csv_lines")
    assert csv_points.good_points(real).count() + csv_points.bad_records(real).count() == real.where("line_no <> 1").count()


def test_plain_lines_are_judged_as_by_the_descent_parser(spark):
    columns = ["label", "x", "strength", "y", "z", "region_name", "id", "acronym"]
    rng = random.Random(4)
    pool = ["", " ", "a", "é b", "1", "-2.5", "+.5e3", "1.", "1e999", "0x1", "7", " 8 ", "+9", "nan", "Ω", "5d", "99999999999999999999", "b;c", "1_0", "µ"]
    raws = [",".join(rng.choice(pool if rng.random() < 0.5 else ["1", "2.5", "a"]) for _ in range(rng.choice([8] * 9 + [7, 9]))) for _ in range(3000)]
    raws += ['"a",1,2,3,4,,,', 'a"b,1,,2,3,,,', "a,1,,2,3,x\ty,,", "a,1,,2,3,�,,", "a,1,,2\u00a0,3,,,", "a,1,,٣,3,,,", "", "a" * 50_000 + ",1,,2,3,,,"]
    lines = spark.createDataFrame([("f", 1, ",".join(columns), T0)] + [("f", n + 2, raw, T0) for n, raw in enumerate(raws)], "csv_file string, line_no int, raw string, received_at timestamp")
    got = {r["line_no"]: r for r in csv_points.parse_point_lines(lines).collect()}
    for n, raw in enumerate(raws):
        row, reason, at, wrong = csv_points.parse_record(raw, columns)
        r = got[n + 2]
        assert (r["reason"], r["error_at"], r["error_field"]) == (reason, at if at >= 0 else None, wrong), raw
        assert {c: r[c] for c in (*csv_points.COLUMNS, "extras")} == csv_points._typed({k: v for k, v in row.items()}, reason) | ({"extras": r["extras"]} if reason else {}), raw


@pytest.mark.parametrize("size", [7, 40, 150, 1 << 20])
def test_files_are_read_in_ranges_from_anchor_to_anchor(spark, tmp_path, size):
    rng = random.Random(6)
    lines, want = ["label,x,y,z,note"], []
    for n in range(120):
        k = rng.random()
        if k < 0.1:
            lines.append(f'm{n},1,2,3,"two\nlines, ""quoted"""')
            want.append((f"m{n}", None))
        elif k < 0.15:
            lines.append(f'm{n},1,2,3,"broken')
            want.append((None, "bad_quoting"))
        elif k < 0.2:
            lines.append(f"m{n},1,2")
            want.append((None, "column_count"))
        elif k < 0.25:
            lines.append(f"m{n},one,2,3,Größe")
            want.append((None, "invalid_value"))
        else:
            lines += [f"m{n},{n},2,3,Größe", f"k{n},{n},2,3,", f"l{n},{n},2,3,"]
            want += [(f"{c}{n}", None) for c in "mkl"]
    (tmp_path / "p.csv").write_text("\r\n".join(lines), encoding="utf-8", newline="")
    got = csv_points.read_point_files(spark, [str(tmp_path)], size).orderBy("record_at").collect()
    whole = csv_points.read_point_files(spark, [str(tmp_path)]).orderBy("record_at").collect()
    assert [tuple(r) for r in got] == [tuple(r) for r in whole]
    # A damaged record ends at the next anchor: no good record goes with it.
    assert {r["label"] for r in got if r["label"]} == {x for x, _ in want if x}
    assert {r["reason"] for r in got} == {None, "bad_quoting", "column_count", "invalid_value"}
