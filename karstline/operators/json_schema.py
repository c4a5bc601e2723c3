"""JSON documents against a JSON Schema, and configurations against a vocabulary: expressions over VARIANT, for any number of documents at once."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FOUND = "array<struct<path:string,rule:string>>"
UUID = "^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$"


def _none() -> Column:
    return F.array().cast(FOUND)


def _one(path: Column, rule: str) -> Column:
    return F.array(F.struct(path.alias("path"), F.lit(rule).alias("rule")))


def _let(value: Column, f) -> Column:
    """f(value), where value is computed once however often f names it: the argument of a lambda is not written out again, as columns are."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _all(found: list[Column]) -> Column:
    return F.flatten(F.array(_none(), *found))


def facts(v: Column) -> Column:
    """Struct of a VARIANT v, of its kind as kind() says, and of what it holds by that: text, number, items, fields, each null for other kinds."""
    def opened(v: Column) -> Column:
        return F.struct(v.alias("v"), F.try_variant_get(v, "$", "map<string,variant>").alias("fields"), F.try_variant_get(v, "$", "array<variant>").alias("items"))

    def scalar(b: Column) -> Column:  # only what holds nothing is looked at, so that no value is walked again for each level above it
        return F.when(b["fields"].isNull() & b["items"].isNull(), F.schema_of_variant(b["v"]))

    def named(b: Column) -> Column:
        s = b["s"]
        number = F.when(s.isNotNull() & ~s.isin("STRING", "BOOLEAN", "VOID"), F.try_variant_get(b["v"], "$", "double"))
        return F.struct(b["b"].alias("b"), s.alias("s"), number.alias("number"))

    def held(c: Column) -> Column:
        b, s, number = c["b"], c["s"], c["number"]
        kind = (
            F.when(b["fields"].isNotNull(), "object").when(b["items"].isNotNull(), "array").when(s == "STRING", "string").when(s == "BOOLEAN", "boolean").when(s == "VOID", "null")
            .when(number == F.floor(number), "integer").when(number.isNotNull(), "number"))
        text = F.when(s == "STRING", F.try_variant_get(b["v"], "$", "string"))
        return F.struct(b["v"].alias("v"), kind.alias("kind"), text.alias("text"), number.alias("number"), b["items"].alias("items"), b["fields"].alias("fields"))

    shape = _let(_let(v, opened), lambda b: F.struct(b.alias("b"), b["v"].alias("v"), scalar(b).alias("s")))
    return _let(_let(shape, named), held)


def kind(v: Column) -> Column:
    """object, array, string, boolean, null, integer (whole numbers, 2.0 included) or number; null for no value."""
    return facts(v)["kind"]


def _rules(schema: dict | bool, root: dict, x: Column, path: Column, formats: bool) -> list[Column]:
    """Arrays of violations of the value that facts x are of, one a keyword; a keyword says nothing about values of types that it isn't for."""
    if schema is True:
        return []
    if schema is False:
        return [_one(path, "false")]
    if "$ref" in schema:
        at = root
        for part in schema["$ref"].removeprefix("#/").split("/"):
            at = at[part]
        return _rules(at, root, x, path, formats)
    out, k, text, number = [], x["kind"], x["text"], x["number"]

    def say(rule: str, applies: Column, ok: Column) -> None:
        out.append(F.when(applies & ~ok, _one(path, rule)).otherwise(_none()))

    if "type" in schema:
        types = schema["type"] if isinstance(schema["type"], list) else [schema["type"]]
        say("type", F.lit(True), k.isin(*types, *(["integer"] if "number" in types else [])))
    for rule, values in (("enum", schema.get("enum")), ("const", [schema["const"]] if "const" in schema else None)):
        if values is not None:
            # numbers by value, all else by kind and text
            same = F.lit(False)
            for value in values:
                if isinstance(value, (int, float)) and not isinstance(value, bool):
                    same |= k.isin("integer", "number") & (number == float(value))
                else:
                    same |= F.to_json(x["v"]) == json.dumps(value, separators=(",", ":"), ensure_ascii=False)
            say(rule, F.lit(True), F.coalesce(same, F.lit(False)))
    is_text, is_number = k == "string", k.isin("integer", "number")
    if "pattern" in schema:
        say("pattern", is_text, text.rlike(schema["pattern"]))
    if formats and schema.get("format") == "uuid":
        say("format", is_text, text.rlike(UUID))
    for rule, ok in (("minLength", lambda n: F.length(text) >= n), ("maxLength", lambda n: F.length(text) <= n)):
        if rule in schema:
            say(rule, is_text, ok(schema[rule]))
    for rule, ok in (("minimum", lambda n: number >= n), ("maximum", lambda n: number <= n), ("exclusiveMinimum", lambda n: number > n), ("exclusiveMaximum", lambda n: number < n)):
        if rule in schema:
            say(rule, is_number, ok(schema[rule]))
    if schema.keys() & {"items", "minItems", "maxItems"}:
        items = x["items"]
        for rule, ok in (("minItems", lambda n: F.size(items) >= n), ("maxItems", lambda n: F.size(items) <= n)):
            if rule in schema:
                say(rule, k == "array", ok(schema[rule]))
        if "items" in schema:
            each = F.transform(items, lambda e, i: _judged(e, schema["items"], root, F.concat(path, F.lit("["), i.cast("string"), F.lit("]")), formats))
            out.append(F.coalesce(F.flatten(each), _none()))
    if schema.keys() & {"properties", "required", "additionalProperties"}:
        fields = x["fields"]
        for name in schema.get("required", []):
            out.append(F.when((k == "object") & ~F.map_contains_key(fields, name), _one(F.concat(path, F.lit(f".{name}")), "required")).otherwise(_none()))
        known = schema.get("properties", {})
        for name, sub in known.items():
            if sub is not True:
                inner = _judged(F.element_at(fields, F.lit(name)), sub, root, F.concat(path, F.lit(f".{name}")), formats)
                out.append(F.when(F.coalesce(F.map_contains_key(fields, name), F.lit(False)), inner).otherwise(_none()))
        more = schema.get("additionalProperties", True)
        if more is not True:
            rest = F.filter(F.map_entries(fields), lambda e: ~e["key"].isin(*known)) if known else F.map_entries(fields)
            place = lambda e: F.concat(path, F.lit("."), e["key"])
            if more is False:
                found = F.transform(rest, lambda e: F.struct(place(e).alias("path"), F.lit("additionalProperties").alias("rule")))
            else:
                found = F.flatten(F.transform(rest, lambda e: _judged(e["value"], more, root, place(e), formats)))
            out.append(F.coalesce(found, _none()))
    return out


def _judged(v: Column, schema: dict | bool, root: dict, path: Column, formats: bool) -> Column:
    return _let(facts(v), lambda x: _all(_rules(schema, root, x, path, formats)))


def violations(text: Column, schema: dict, formats: bool = True) -> Column:
    """What a JSON text breaks of a schema: array of (path, rule), the rule being the keyword, the path $.a.b[0]; empty if nothing. A null or broken text
    breaks 'json'.

    Keywords: type, required, properties, additionalProperties, items, enum, const, pattern, minimum, maximum and their exclusive forms, minLength, maxLength, minItems, maxItems,
    $ref within the document, and format uuid if formats is on; others are not looked at. Schemas must not refer to themselves."""
    return _let(facts(F.try_parse_json(text)), lambda x: F.when(x["v"].isNull(), _one(F.lit("$"), "json")).otherwise(_all(_rules(schema, schema, x, F.lit("$"), formats))))


def _dealt(docs: DataFrame, *columns: str) -> DataFrame:
    """docs over all cores: judging costs far more than reading, and a small file would come to one task."""
    return docs.select(*columns).repartition(max(docs.sparkSession.sparkContext.defaultParallelism, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))


def all_violations(docs: DataFrame, id_: str, text: str, schema: dict, formats: bool = True) -> DataFrame:
    """id_, path, rule: a row for each violation of each document."""
    return _dealt(docs, id_, text).select(id_, F.inline(violations(F.col(text), schema, formats)))


# The adapter's configuration, a kind for each key (its stages are the sections), and words that belong to a calibration.
SECTIONS = {
    "feature_extractor": {"max_image_size": "int", "max_num_features": "int", "detector": "string", "descriptor": "string", "sift_scale_space_octaves": "string", "sift_domain_size_pooling": "string"},
    "matcher": {"guided_matching": "bool", "max_ratio": "double", "max_distance": "double", "cross_check": "bool"},
    "mapper": {"min_num_matches": "int", "ba_refine_principal_point": "bool", "ba_min_num_residuals_for_multithreading": "int"},
}
TOP = ("threads", "seed", *SECTIONS, "enabled_stages")
FORBIDDEN = ("fx", "fy", "cx", "cy", "distortion", "intrinsics", "extrinsics", "calibration")
ENVELOPE = ("pipeline_id", "pipeline_version", "stage", "config")


def effective(text: Column) -> Column:
    """The configuration of a text as VARIANT: {} for a blank one, what stands in `config` of a pipeline's envelope; null for broken JSON."""
    return _let(_parsed(text), _unwrapped)


def _parsed(text: Column) -> Column:
    blank = text.isNull() | text.rlike("^[ \\t\\r\\n]*$")
    return F.when(blank, F.parse_json(F.lit("{}"))).otherwise(F.try_parse_json(text))


def _at(v: Column, path: str, type_: str = "variant") -> Column:
    return F.try_variant_get(v, path, type_)


def _fields(v: Column, path: str = "$") -> Column:
    return _at(v, path, "map<string,variant>")


def _unwrapped(v: Column) -> Column:
    """What stands in `config` of a VARIANT that is an envelope, v itself if it is none. Fields are counted only where all names are there."""
    wrapped = _fields(v, "$.config").isNotNull()
    for k in ENVELOPE:
        wrapped &= _at(v, f"$.{k}").isNotNull()
    return F.when(F.coalesce(wrapped, F.lit(False)) & (F.size(_fields(v)) == len(ENVELOPE)), _at(v, "$.config")).otherwise(v)


def forbidden_keys(configs: DataFrame, id_: str, most_depth: int = 1000) -> DataFrame:
    """id_, path, key of every object key of configs(id_, config as VARIANT) that belongs to a calibration, at any depth: all documents are opened one level a round, until
    no object or list is left that holds such a key. Rounds are written, since the next one's plan would else hold all before it."""
    from .graph import forget, written

    # What a text of JSON is shows in its first letter; these keys need no escapes, so a value that holds one at any depth has it in its text as it is here.
    def holds(t: Column) -> Column:
        return F.left(t, F.lit(1)).isin("{", "[") & t.rlike('"(' + "|".join(FORBIDDEN) + ')":')

    # a list of one or none instead of a filter, which Spark would move below what makes the text and so make it once more for each of its parts
    level = configs.select(id_, F.lit("$").alias("path"), F.explode_outer(F.filter(F.array(F.to_json("config")), holds)).alias("__v")).where("__v is not null")
    found = None
    for _ in range(most_depth):
        key = F.lit(None).cast("string")
        entries = _let(F.try_parse_json("__v"), lambda v: F.coalesce(
            F.transform(F.map_entries(_fields(v)), lambda e: F.struct(F.concat(F.lit("."), e["key"]).alias("step"), e["key"].alias("key"), F.to_json(e["value"]).alias("__v"))),
            F.transform(_at(v, "$", "array<variant>"), lambda e, i: F.struct(F.concat(F.lit("["), i.cast("string"), F.lit("]")).alias("step"), key.alias("key"), F.to_json(e).alias("__v")))))
        opened = level.select(id_, "path", F.inline_outer(entries)).where(F.col("key").isin(*FORBIDDEN) | holds(F.col("__v")))
        opened = written(opened.select(id_, F.concat("path", "step").alias("path"), "key", "__v"))
        if opened.isEmpty():
            forget(opened)
            return found if found is not None else configs.select(id_, F.lit("").alias("path"), F.lit("").alias("key")).limit(0)
        bad = opened.where(F.col("key").isin(*FORBIDDEN)).select(id_, "path", "key")
        found = bad if found is None else found.unionByName(bad)
        level = opened.where(holds(F.col("__v"))).select(id_, "path", "__v")
    raise ValueError(f"deeper than {most_depth} levels")


def config_violations(docs: DataFrame, id_: str, text: str) -> DataFrame:
    """id_, path, rule: everything that is wrong with adapter configurations, one row each; a document without a row is valid.

    Rules: json, calibration (a forbidden word as a key, at any depth), object, unknown_key, type, threads (0 or below -1), unknown_stage, duplicate_stage. Numbers count as whole or
    fractional alike, and true and false as numbers, as the adapter's conversions do. What several rules ask for is a column of a step before, not a lambda, so that it is compiled."""
    t, v = F.col(text), F.col("config")

    def configs(docs: DataFrame) -> DataFrame:
        parsed = _dealt(docs, id_, text).select(id_, _parsed(t).alias("config"))
        return parsed.select(id_, _unwrapped(v).alias("config"))

    known = {"$": TOP} | {f"$.{name}": keys for name, keys in SECTIONS.items()}
    kinds = {"$.threads": "int", "$.seed": "string"} | {f"$.{name}.{k}": t for name, keys in SECTIONS.items() for k, t in keys.items()}
    shape = {p: F.col(f"s{i}") for i, p in enumerate(kinds)}
    keys = {p: F.col(f"k{i}") for i, p in enumerate(known)}
    named = F.transform(_at(v, "$.enabled_stages", "array<variant>"), lambda e: F.when(F.schema_of_variant(e) == "STRING", _at(e, "$", "string")))
    n = F.when(shape["$.threads"] == "BOOLEAN", _at(v, "$.threads", "boolean").cast("double")).otherwise(_at(v, "$.threads", "double"))
    looked = configs(docs).select(
        id_, "config", named.alias("named"), *[F.schema_of_variant(_at(v, p)).alias(f"s{i}") for i, p in enumerate(kinds)], *[F.map_keys(_fields(v, p)).alias(f"k{i}") for i, p in enumerate(known)])
    looked = looked.withColumn("threads", F.when(n >= 0, F.floor(n)).otherwise(F.ceil(n)))

    def wrong(cond: Column, path: str, rule: str) -> Column:
        return F.when(cond, F.struct(F.lit(path).alias("path"), F.lit(rule).alias("rule")))

    def unknown(p: str) -> Column:
        extra = F.array_except(keys[p], F.array(*[F.lit(k) for k in known[p]]))
        return F.transform(extra, lambda k: F.struct(F.concat(F.lit(f"{p}."), k).alias("path"), F.lit("unknown_key").alias("rule")))

    def fit(p: str) -> Column:
        s = shape[p]
        return {"bool": s == "BOOLEAN", "string": s == "STRING"}.get(kinds[p], ~F.left(s, F.lit(4)).isin("STRI", "VOID", "OBJE", "ARRA"))

    stages, count = F.col("named"), F.col("threads")
    at = lambda i: F.concat(F.lit("$.enabled_stages["), i.cast("string"), F.lit("]"))
    judged = F.transform(stages, lambda s, i: F.when(s.isNull(), F.struct(at(i).alias("path"), F.lit("type").alias("rule"))).when(
        ~s.isin(*SECTIONS), F.struct(at(i).alias("path"), F.lit("unknown_stage").alias("rule"))).when(
        F.array_position(stages, s) <= i, F.struct(at(i).alias("path"), F.lit("duplicate_stage").alias("rule"))))
    single = F.array(
        wrong(v.isNull(), "$", "json"), wrong(v.isNotNull() & keys["$"].isNull(), "$", "object"), *[wrong(~fit(p), p, "type") for p in kinds],
        wrong(fit("$.threads") & ((count == 0) | (count < -1)), "$.threads", "threads"),
        *[wrong(_at(v, p).isNotNull() & keys[p].isNull(), p, "type") for p in known if p != "$"], wrong(_at(v, "$.enabled_stages").isNotNull() & stages.isNull(), "$.enabled_stages", "type"))
    # outer, as Spark would else judge each document once more, to leave out those without a row
    lists = F.array(single, *[unknown(p) for p in known], judged)
    flat = looked.select(id_, F.explode_outer(F.flatten(F.array_compact(lists))).alias("x")).where("x is not null").select(id_, "x.path", "x.rule")
    # without such a word and without escapes no text has such a key, and needs no parsing for it
    words = forbidden_keys(configs(docs.where(t.rlike("|".join([*FORBIDDEN, r"\\"])))), id_).select(id_, "path", F.lit("calibration").alias("rule"))
    return flat.unionByName(words)
