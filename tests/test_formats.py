"""Trajectory text, schemas, configurations, clocks: against plain readings, with odd input."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from karstline.functions import errors
from karstline.operators import clocks, graph, json_schema
from karstline.plans import schemas
from karstline.sources import trajectory_text as T

KINDS = "file string, line_no long, value string"


def test_lines_of_each_format(spark):
    half = "0.7071067811865476"
    rows = {
        "a": ["# timestamp tx ty tz qx qy qz qw", "1305031102.175304 1 2 3 0 0 0 2", "  1.5e0\t-1 2e1 3 0 0 1 1\r", "", None, "1 2 3", "1 2 3 4 5 6 7 x", "99999999999 1 2 3 0 0 0 1", "1 2 3 4 0 0 0 0", "1 nan 3 4 0 0 0 1"],
        "b": ["0 -1 0 7 1 0 0 8 0 0 1 9", "1 0 0 0 0 1 0 0 0 0 -1 0", "1 0 0 0 0 2 0 0 0 0 1 0", "0,1,2,3,1,0,0,0"],
        "c": ["#timestamp [ns], p_x", f"1403636579763555584, 1, 2, 3, {half}, {half}, 0, 0, 9, 9, 9", "1.5,1,2,3,1,0,0,0", "1403636579763555584,1,2,3,1,0,0", "9223372036854775808,1,2,3,1,0,0,0"],
        "d": ["no fields here"],
    }
    df = spark.createDataFrame([(f, i, v) for f, vs in rows.items() for i, v in enumerate(vs)], KINDS)
    poses, bad = T.parse(df)
    got = {(r.file, r.line_no): (r.format, r.timestamp_ns, tuple(r.t), tuple(round(x, 6) for x in r.q)) for r in poses.collect()}
    s = round(float(half), 6)
    assert got == {
        ("a", 1): ("tum", 1305031102175304000, (1, 2, 3), (0, 0, 0, 1)), ("a", 2): ("tum", 1500000000, (-1, 20, 3), (0, 0, s, s)),
        ("b", 0): ("kitti", None, (7, 8, 9), (0, 0, s, s)), ("c", 1): ("euroc", 1403636579763555584, (1, 2, 3), (s, 0, 0, s)),
    }
    assert {(r.file, r.line_no): r.reason for r in bad.collect()} == {
        ("a", 5): "fields", ("a", 6): "number", ("a", 7): "timestamp", ("a", 8): "rotation", ("a", 9): "number", ("b", 1): "rotation", ("b", 2): "rotation", ("b", 3): "format",
        ("c", 2): "timestamp", ("c", 3): "fields", ("c", 4): "timestamp", ("d", 0): "fields"}
    forced, other = T.parse(df.where("file = 'b'"), fmt="euroc")
    assert forced.count() == 1 and {r.reason for r in other.collect()} == {"format"}
    for x in T.parse(df.limit(0)):
        assert x.collect() == []


@pytest.mark.parametrize("fmt", T.FORMATS)
def test_round_trip_through_files(spark, tmp_path, fmt):
    rng = random.Random(1)
    rows = []
    for i in range(300):
        q = [rng.gauss(0, 1) for _ in range(4)]
        n = sum(x * x for x in q) ** 0.5
        rows.append((i, 1_700_000_000_000_000_000 + i * 33_333_333 if i else 0, tuple(rng.gauss(0, 100) for _ in range(3)), tuple(x / n for x in q)))
    df = spark.createDataFrame(rows, "i int, timestamp_ns long, t struct<x: double, y: double, z: double>, q struct<x: double, y: double, z: double, w: double>")
    (tmp_path / "one").mkdir()
    for name, part in (("x.txt", df), ("y.txt", df.where("i < 5"))):
        (tmp_path / "one" / name).write_text("# head\n" + "\n".join(r[0] for r in part.orderBy("i").select(T.line(fmt)).collect()) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    try:
        lines = T.read_lines(spark, str(tmp_path / "one"))
        assert lines.rdd.getNumPartitions() > 3
        poses, bad = T.parse(lines)
        assert bad.count() == 0
        got = {(r.file.rsplit("/", 1)[1], r.line_no): r for r in poses.collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert set(got) == {("x.txt", i + 1) for i in range(300)} | {("y.txt", i + 1) for i in range(5)}
    for i, ts, t, q in rows:
        r = got["x.txt", i + 1]
        assert r.format == fmt and tuple(r.t) == t and r.timestamp_ns == (None if fmt == "kitti" else ts)
        sign = 1 if sum(a * b for a, b in zip(r.q, q)) > 0 else -1
        assert tuple(r.q) == pytest.approx([sign * x for x in q], abs=1e-9)


def plain_schema(schema, root, v, path="$"):
    """The keywords one after another, over parsed values."""
    if "$ref" in schema:
        return plain_schema(root["definitions"][schema["$ref"].rsplit("/", 1)[1]], root, v, path)
    number = isinstance(v, (int, float)) and not isinstance(v, bool)
    kinds = {"object": isinstance(v, dict), "array": isinstance(v, list), "string": isinstance(v, str), "boolean": isinstance(v, bool), "null": v is None, "number": number, "integer": number and v == int(v)}
    out = []
    types = schema.get("type", [])
    if types and not any(kinds[t] for t in ([types] if isinstance(types, str) else types)):
        out.append((path, "type"))
    if "const" in schema and (v != schema["const"] or isinstance(v, bool) != isinstance(schema["const"], bool)):
        out.append((path, "const"))
    if "enum" in schema and not any(v == x and isinstance(v, bool) == isinstance(x, bool) for x in schema["enum"]):  # 1 is not true
        out.append((path, "enum"))
    if kinds["string"]:
        out += [(path, "format")] * (schema.get("format") == "uuid" and not re.search(json_schema.UUID, v)) + [(path, "minLength")] * (len(v) < schema.get("minLength", 0)) + [(path, "pattern")] * (not re.search(schema.get("pattern", ""), v))
    if number:
        out += [(path, "minimum")] * (v < schema.get("minimum", v)) + [(path, "maximum")] * (v > schema.get("maximum", v)) + [(path, "exclusiveMinimum")] * (v <= schema.get("exclusiveMinimum", v - 1))
    if kinds["array"]:
        out += [(path, "minItems")] * (len(v) < schema.get("minItems", 0)) + [(path, "maxItems")] * (len(v) > schema.get("maxItems", len(v)))
        for i, x in enumerate(v):
            out += plain_schema(schema.get("items", {}), root, x, f"{path}[{i}]")
    if kinds["object"]:
        out += [(f"{path}.{k}", "required") for k in schema.get("required", []) if k not in v]
        for k, x in v.items():
            if k in schema.get("properties", {}):
                out += plain_schema(schema["properties"][k], root, x, f"{path}.{k}")
            elif schema.get("additionalProperties", True) is False:
                out.append((f"{path}.{k}", "additionalProperties"))
            elif schema.get("additionalProperties", True) is not True:
                out += plain_schema(schema["additionalProperties"], root, x, f"{path}.{k}")
    return out


MIXED = {
    "type": "object", "required": ["a", "n"], "additionalProperties": {"type": ["string", "null"], "minLength": 2},
    "properties": {
        "a": {"type": "array", "minItems": 1, "maxItems": 3, "items": {"$ref": "#/definitions/Item"}}, "n": {"type": "number", "exclusiveMinimum": 0, "maximum": 10}, "k": {"enum": ["x", 2, True, None]},
        "o": {"type": "object", "properties": {"deep": {"type": "array", "items": {"type": "array", "items": {"type": "integer"}}}}, "additionalProperties": False},
    },
    "definitions": {"Item": {"type": "object", "required": ["id"], "properties": {"id": {"type": "string", "pattern": "^[a-f]+$"}, "v": {"const": 1}}}},
}


@pytest.mark.parametrize("schema", [MIXED, schemas.TRAJECTORY, schemas.QUALITY_REPORT, schemas.FEATURES], ids=["mixed", "trajectory", "report", "features"])
def test_schema_rules(spark, schema):
    rng = random.Random(3)
    values = [None, True, 0, 1, -1, 2, 2.0, 2.5, 11, "", "x", "abc", "q", "é", [], {}, [1, "a"], {"id": "abc", "v": 1.0}, {"id": "z"}, {"deep": [[1, 2.0], [1.5], "s"], "b": 1}, [{"id": "a"}, {"v": 2}]]

    def filled(s, root, depth=0):
        """A value that fits, with something else here and there."""
        if "$ref" in s:
            s = root["definitions"][s["$ref"].rsplit("/", 1)[1]]
        if rng.random() < 0.12 or depth > 5:
            return rng.choice(values)
        if "const" in s or "enum" in s:
            return s.get("const", rng.choice(s.get("enum", [0])))
        kind = s.get("type")
        if kind == "object":
            out = {k: filled(x, root, depth + 1) for k, x in s.get("properties", {}).items() if rng.random() < 0.93}
            return out | ({"more": rng.choice(values)} if rng.random() < 0.2 else {})
        if kind == "array":
            return [filled(s.get("items", {}), root, depth + 1) for _ in range(max(0, s.get("minItems", 2) + rng.choice([0, 0, 0, 1, -1])))]
        return {"string": "123e4567-e89b-42d3-a456-426614174000" if s.get("format") else "abc", "integer": rng.choice([1, 5, -3]), "number": rng.choice([1, 2.5, -1, 200])}.get(kind if isinstance(kind, str) else "string", "abc")

    docs = [filled(schema, schema) for _ in range(150)] + values
    df = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(docs)] + [(9001, None), (9002, "{"), (9003, "")], "id int, text string")
    got = sorted((r.id, r.path, r.rule) for r in json_schema.all_violations(df, "id", "text", schema).collect())
    want = sorted((i, p, r) for i, d in enumerate(docs) for p, r in plain_schema(schema, schema, d))
    assert got == want + [(i, "$", "json") for i in (9001, 9002, 9003)]
    assert json_schema.all_violations(df.limit(0), "id", "text", schema).collect() == []


def test_a_document_is_parsed_once(spark):
    text = F.col("text")
    assert str(json_schema.violations(text, schemas.TRAJECTORY)).count("try_parse_json") == 1
    assert str(json_schema.effective(text)).count("try_parse_json") == 1


def test_configurations(spark):
    docs = {
        1: "", 2: " \n\t", 3: "{}", 4: None, 5: "{x", 6: "[1]", 7: "5",
        8: '{"threads":-1,"seed":"s","mapper":{"min_num_matches":3.5,"ba_refine_principal_point":true},"matcher":{"max_ratio":1,"cross_check":false},"enabled_stages":["mapper","matcher"]}',
        9: '{"threads":-2}', 10: '{"threads":0.5}', 11: '{"threads":false}', 12: '{"threads":"1"}', 13: '{"seed":1,"matcher":{"guided_matching":1,"x":2},"other":1}', 14: '{"mapper":[]}',
        15: '{"enabled_stages":"mapper"}', 16: '{"enabled_stages":["mapper",5,"nowhere","mapper"]}', 17: '{"feature_extractor":{"detector":"d","fx":1},"matcher":{"y":[[{"distortion":{"cx":0}}]]}}',
        18: '{"pipeline_id":"p","pipeline_version":"1","stage":"s","config":{"threads":0}}', 19: '{"pipeline_id":"p","pipeline_version":"1","stage":"s","config":5}', 20: '[{"intrinsics":{}}]',
    }
    want = {
        (5, "$", "json"), (6, "$", "object"), (7, "$", "object"), (9, "$.threads", "threads"), (10, "$.threads", "threads"), (11, "$.threads", "threads"), (12, "$.threads", "type"),
        (13, "$.seed", "type"), (13, "$.matcher.guided_matching", "type"), (13, "$.matcher.x", "unknown_key"), (13, "$.other", "unknown_key"), (14, "$.mapper", "type"), (15, "$.enabled_stages", "type"),
        (16, "$.enabled_stages[1]", "type"), (16, "$.enabled_stages[2]", "unknown_stage"), (16, "$.enabled_stages[3]", "duplicate_stage"), (17, "$.feature_extractor.fx", "unknown_key"), (17, "$.feature_extractor.fx", "calibration"),
        (17, "$.matcher.y", "unknown_key"), (17, "$.matcher.y[0][0].distortion", "calibration"), (17, "$.matcher.y[0][0].distortion.cx", "calibration"), (18, "$.threads", "threads"),
        *[(19, f"$.{k}", "unknown_key") for k in json_schema.ENVELOPE], (20, "$", "object"), (20, "$[0].intrinsics", "calibration"),
    }
    df = spark.createDataFrame(list(docs.items()), "id int, text string")
    got = [tuple(r) for r in json_schema.config_violations(df, "id", "text").collect()]
    assert set(got) == want and len(got) == len(want)
    assert json_schema.config_violations(df.limit(0), "id", "text").collect() == []


def test_only_ways_to_forbidden_keys_are_opened(spark, monkeypatch):
    docs = {1: '{"matcher":{"a":[{"b":{}}],"c":{"\\u0066x":{"cy":1}}},"mapper":{"d":{"e":[[]]}}}', 2: '{"mapper":{"a":{"b":{"c":"no fx"}}}}', 3: '{"seed":"\\"fx\\":"}', 4: '{"a":[{"b":2},{"distortion":null}]}'}
    real, seen = graph.written, []

    def written(df):
        out = real(df)
        seen.extend((r[0], r.path) for r in out.collect())
        return out

    monkeypatch.setattr(graph, "written", written)
    df = spark.createDataFrame(list(docs.items()), "id int, text string")
    got = json_schema.config_violations(df, "id", "text").where("rule = 'calibration'")
    assert sorted((r.id, r.path) for r in got.collect()) == [(1, "$.matcher.c.fx"), (1, "$.matcher.c.fx.cy"), (4, "$.a[1].distortion")]
    assert sorted(seen) == [(1, "$.matcher"), (1, "$.matcher.c"), (1, "$.matcher.c.fx"), (1, "$.matcher.c.fx.cy"), (4, "$.a"), (4, "$.a[1]"), (4, "$.a[1].distortion")]


def test_clocks(spark):
    rng = random.Random(2)
    true, domains, links = {}, [], []
    for rig in range(12):
        for k in range(8):
            true[rig * 10 + k] = rng.randrange(-1000, 1000) if k else 0
            domains.append((rig * 10 + k, k == 0 and rig != 11 or None))
        tree = [(rig * 10 + k, rig * 10 + rng.randrange(k)) for k in range(1, 8)]
        # rig 3 lost its links to 5; 4 has a link that contradicts; 5 a self link of other than 0; 6 one more link that agrees; 11 has no platform domain
        tree = [e for e in tree if rig != 3 or 35 not in e] + ([(67, 61), (66, 66)] if rig == 6 else [])
        links += [(a, b, true[a] - true[b]) if rng.random() < 0.5 else (b, a, true[b] - true[a]) for a, b in tree]
    links += [(41, 47, true[41] - true[47] + 1), (52, 52, 3), (None, 1, 2), (1, 999, 2), (2, 1, None), links[0], links[0]]
    d = spark.createDataFrame(domains + [(None, True), (0, True)], "domain long, is_platform boolean")
    got = {r.domain: r for r in clocks.resolve_clocks(d, spark.createDataFrame(links, "a long, b long, offset_ns long")).collect()}
    assert set(got) == set(true)
    lost = {x for x, r in got.items() if r.error == "unresolvable"}
    assert 35 in lost and {110 + k for k in range(8)} <= lost and {x // 10 for x in lost} <= {3, 11}
    for x, r in got.items():
        if x in lost:
            assert r.root is None and r.offset_ns is None
        elif x // 10 in (4, 5):
            assert (r.error, r.offset_ns) == ("contradictory", None)
        else:
            assert (r.error, r.root) == (None, x // 10 * 10) and r.offset_ns == true[x], x
    resolved = clocks.resolve_clocks(d, spark.createDataFrame(links, "a long, b long, offset_ns long"))
    read = spark.createDataFrame([(1, 5), (41, 5), (35, 5), (12345, 5), (None, 5)], "domain long, t long")
    out = {r.domain: (r.platform_ns, r.clock_error) for r in clocks.to_platform(read, resolved, "domain", "t").collect()}
    assert out == {1: (5 + true[1], None), 41: (None, "contradictory"), 35: (None, "unresolvable"), 12345: (None, "unresolvable"), None: (None, "unresolvable")}
    assert clocks.resolve_clocks(d.limit(0), spark.createDataFrame([], "a long, b long, offset_ns long")).collect() == []


def test_clocks_in_long_chains(spark):
    """Rounds follow forks, not links: a chain between two platform domains, a loop that comes back to a fork, a ring without a platform."""
    n = 301
    chain = [(0, 1, 5), *[(i, i + 1, i) for i in range(1, n)], (n, -1, 7), (3, 2, -1)]  # the last one goes along 2-3 with another offset
    loop = [(150, 1000, 1), *[(i, i + 1, 1) for i in range(1000, 1040)], (1040, 150, -41)]
    ring = [(2000 + i, 2000 + (i + 1) % 9, 0) for i in range(9)]
    names = {x for a, b, _ in chain + loop + ring for x in (a, b)}
    d = spark.createDataFrame([(x, x in (0, -1)) for x in names], "domain long, is_platform boolean")
    near = {}
    for a, b, o in chain + loop + ring:
        near.setdefault(a, []).append((b, -o))
        near.setdefault(b, []).append((a, o))
    want, front = {0: (0, 0), -1: (-1, 0)}, [0, -1]
    while front:
        found = {}
        for x in front:
            for y, step in near[x]:
                if y not in want:
                    found[y] = min(found.get(y, (9**9,)), (want[x][0], x, want[x][1] + step))
        want |= {y: (root, o) for y, (root, _, o) in found.items()}
        front = list(found)
    got = {r.domain: r for r in clocks.resolve_clocks(d, spark.createDataFrame(chain + loop + ring, "a long, b long, offset_ns long"), 8).collect()}
    assert {x: r.root for x, r in got.items() if r.root is not None} == {x: r for x, (r, _) in want.items()} and len(got) == len(names)
    assert {r.error for x, r in got.items() if x >= 2000} == {"unresolvable"} and got[150].error == "contradictory"
    # without the odd link and the second platform domain all offsets stand
    plain = spark.createDataFrame([x for x in chain + loop if x != (3, 2, -1) and x[1] != -1], "a long, b long, offset_ns long")
    got = {r.domain: r for r in clocks.resolve_clocks(d, plain, 8).collect()}
    assert all(got[i].offset_ns == -5 - i * (i - 1) // 2 for i in range(1, n + 1)) and got[1001].offset_ns == got[150].offset_ns - 2 and got[1040].error is None


def test_error_codes(spark):
    rows = errors.error_codes(spark).collect()
    assert len(rows) == 47 == len({r.code for r in rows}) and {r.domain for r in rows if r.code // 1000 == 4} == {"COORDINATE"}
    df = spark.createDataFrame([("UnsupportedFormat",), ("nothing",), (None,)], "error string")
    assert {(r.error, r.error_code, r.error_name) for r in errors.with_code(df, "error", "IMPORT").collect()} == {("UnsupportedFormat", 6003, "IMPORT_UNSUPPORTED_FORMAT"), ("nothing", None, None), (None, None, None)}
