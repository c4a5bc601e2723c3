"""Hashes and deterministic identifiers as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the namespace of all derived identifiers.
NAMESPACE = "1a2b3c4d-5e6f-4a8b-9c0d-1e2f3a4b5c6d"
UUID_PATTERN = "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"


def sha256(x: Column) -> Column:
    return F.sha2(x, 256)


def parse_uuid(x: Column) -> Column:
    """Canonical lower-case form, or null if x is no UUID."""
    return F.when(x.rlike(UUID_PATTERN), F.lower(x))


def uuid5(name: Column, namespace: str = NAMESPACE) -> Column:
    """Version-5 UUID: SHA-1 of namespace and name with version and variant bits set."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(F.lit(3)).bitwiseOR(F.lit(8))))
    parts = [F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12)]
    return F.concat_ws("-", *parts)


def entity_id(prefix: str, sensor_id: Column, timestamp_ns: Column, content_hash: Column) -> Column:
    """Identifier of a frame or an observation: same capture, same id, on any machine."""
    return uuid5(F.concat_ws("|", F.lit(prefix), sensor_id, timestamp_ns.cast("string"), content_hash))


def feature_set_id(frame_id: Column, content_hash: Column) -> Column:
    return uuid5(F.concat_ws("|", F.lit("feature_set"), frame_id, content_hash))


def cache_key(task_type: Column, inputs: Column, config_hash: Column, version: Column, commit: Column) -> Column:
    """SHA-256 over lines; the order of inputs does not matter."""
    refs = F.array_join(F.transform(F.array_sort(inputs), lambda r: F.concat(r, F.lit("\n"))), "")
    return sha256(F.concat(task_type, F.lit("\n"), refs, config_hash, F.lit("\n"), version, F.lit("\n"), commit))


def pipeline_hash(pipeline_id: Column, version: Column, commit: Column, config: Column, inputs: Column) -> Column:
    refs = F.array_join(F.transform(F.array_sort(inputs), lambda r: F.concat(r, F.lit("|"))), "")
    return sha256(F.concat_ws("|", pipeline_id, version, commit, sha256(config), refs))


def run_seed(phash: Column, stage: Column, config: Column, inputs: Column) -> Column:
    return sha256(F.concat_ws("|", phash, stage, config, F.array_sort(inputs)))


def placeholder_ref(pipeline_id: Column, stage_id: Column) -> Column:
    return F.concat_ws("/", pipeline_id, stage_id, F.lit("output"))


def canonical_config(config: dict[str, Column]) -> Column:
    """JSON of sorted keys without nulls, as hashed by importers."""
    return F.to_json(F.struct(*[config[k].alias(k) for k in sorted(config)]))


def mock_payload(task_type: Column, config: Column, refs: Column) -> Column:
    """The deterministic payload of a task: type, configuration and input references joined by bars."""
    return F.concat_ws("|", task_type, F.coalesce(config, F.lit("")), refs)
