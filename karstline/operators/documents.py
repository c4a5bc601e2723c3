"""JSON documents of the engine: written from rows, and read back into columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The order of the adapter's stages.
STAGES = ("feature_extractor", "matcher", "mapper")
REPORT = (
    "pipeline_hash string, stage_id string, quality_engine struct<name string, version string, git_commit string>, "
    "thresholds struct<quality_score struct<pass double, warn double>>, metrics struct<reprojection struct<rmse_px double, mean_error_px double>, "
    "coverage struct<completeness_pct double, baseline_ratio double>, geometry struct<point_count double, mean_confidence double>>, "
    "quality_score double, verdict string, generated_at string"
)
REQUIRED = ("pipeline_hash", "stage_id", "quality_engine", "thresholds", "metrics", "quality_score", "verdict")
MANIFEST = (
    "artifact_uuid string, content_hash string, type string, schema_version long, producer struct<id string, version string, git_commit string>, "
    "input_artifact_hashes array<string>, configuration_hash string, creation_timestamp string, coordinate_frame string, unit string, "
    "file_size long, mime_type string, validation_status string, width long, height long, pixel_format string"
)


def refs(text: Column) -> Column:
    """The strings of a JSON array; null, broken text and other values give an empty array."""
    kind = F.schema_of_variant(F.try_parse_json(text))
    items = F.from_json(text, "array<variant>")
    strings = F.transform(F.filter(items, lambda x: F.schema_of_variant(x) == "STRING"), lambda x: x.cast("string"))
    return F.when(F.coalesce(kind.startswith("ARRAY"), F.lit(False)), strings).otherwise(F.array().cast("array<string>"))


def refs_json(values: Column) -> Column:
    return F.to_json(values)


def stage_plan(enabled: Column) -> Column:
    """The stages that are enabled, in their own order; all of them if none is named."""
    every = F.array(*[F.lit(s) for s in STAGES])
    return F.when(F.size(enabled) > 0, F.filter(every, lambda s: F.array_contains(enabled, s))).otherwise(every)


def report_json(df: DataFrame, thresholds: Column) -> Column:
    """Text of a quality report of columns (pipeline_hash, stage_id, rmse_px, ..., quality_score, verdict); keys sorted."""
    group = lambda *names: F.struct(*[F.col(n) for n in sorted(names)])
    metrics = F.struct(
        group("baseline_ratio", "completeness_pct").alias("coverage"), group("mean_confidence", "point_count").alias("geometry"), group("mean_error_px", "rmse_px").alias("reprojection")
    )
    engine = F.struct(*[F.col(f"engine_{n}").alias(n) for n in ("git_commit", "name", "version")])
    return F.to_json(F.struct(
        F.col("generated_at"), metrics.alias("metrics"), F.col("pipeline_hash"), engine.alias("quality_engine"), F.col("quality_score"),
        F.col("stage_id"), F.struct(thresholds.alias("quality_score")).alias("thresholds"), F.col("verdict"),
    ))


def read_report(text: Column) -> tuple[Column, Column]:
    """(report, error): a required key that is missing is the error; missing groups and thresholds read as defaults."""
    r = F.from_json(text, REPORT)
    have = F.json_object_keys(text)
    lacking = F.filter(F.array(*[F.lit(k) for k in REQUIRED]), lambda k: ~F.array_contains(have, k))
    error = F.when(have.isNull(), "not valid JSON").when(F.size(lacking) > 0, F.concat(F.lit("missing "), lacking[0]))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    flat = F.struct(
        r["pipeline_hash"].alias("pipeline_hash"), r["stage_id"].alias("stage_id"), *[F.coalesce(r["quality_engine"][n], F.lit("")).alias(f"engine_{n}") for n in ("name", "version", "git_commit")],
        F.coalesce(r["thresholds"]["quality_score"]["pass"], F.lit(80.0)).alias("pass_at"), F.coalesce(r["thresholds"]["quality_score"]["warn"], F.lit(50.0)).alias("warn_at"),
        *[zero(r["metrics"][g][n]).alias(n) for g, n in (("reprojection", "rmse_px"), ("reprojection", "mean_error_px"), ("coverage", "completeness_pct"), ("coverage", "baseline_ratio"), ("geometry", "point_count"), ("geometry", "mean_confidence"))],
        r["quality_score"].alias("quality_score"), F.when(r["verdict"].isin("pass", "warn"), r["verdict"]).otherwise("fail").alias("verdict"), F.coalesce(r["generated_at"], F.lit("")).alias("generated_at"),
    )
    return F.when(error.isNull(), flat), error


def read_manifest(text: Column) -> tuple[Column, Column]:
    """(manifest, error): id, hash and type are required; a null configuration hash reads as ''."""
    m = F.from_json(text, MANIFEST)
    lacking = F.filter(F.array(*[F.lit(k) for k in ("artifact_uuid", "content_hash", "type")]), lambda k: ~F.array_contains(F.json_object_keys(text), k))
    error = F.when(F.json_object_keys(text).isNull(), "not valid JSON").when(F.size(lacking) > 0, F.concat(F.lit("missing "), lacking[0]))
    return F.when(error.isNull(), m.withField("configuration_hash", F.coalesce(m["configuration_hash"], F.lit("")))), error


def calibration_json() -> Column:
    """Text of a calibration artifact of columns (calibration_id, sensor_id, version, valid_from_ns, valid_to_ns); an open end is left out."""
    return F.to_json(F.struct("calibration_id", "sensor_id", "valid_from_ns", "valid_to_ns", "version"))


def feature_json(keypoints: Column, descriptors: Column) -> Column:
    """Text of a feature artifact; as many descriptors as key points are required."""
    same = F.size(keypoints) == F.size(descriptors)
    return F.when(same, F.to_json(F.struct(descriptors.alias("descriptors"), keypoints.alias("keypoints")))).otherwise(F.raise_error("as many descriptors as key points are required").cast("string"))


#: The JSON columns of a calibration and their keys in its document, whether they must be there.
CALIBRATION_PARTS = {"intrinsics_json": ("intrinsics", True), "distortion_json": ("distortion", False), "extrinsics_json": ("extrinsics", False), "uncertainty_json": ("uncertainty", False)}


def calibration_document(df: DataFrame) -> tuple[Column, Column]:
    """(text, error) of a calibration's document with sorted keys at every depth, so equal calibrations have equal bytes.

    Columns calibration_id, sensor_id, version, calibration_time_ns, source, intrinsic_model, valid_from_ns, valid_to_ns and those of CALIBRATION_PARTS, which hold JSON.
    Empty and null parts are left out, but intrinsics must be there; a part that does not parse, or names a key twice, is the error 'malformed <key>'."""
    own = {c: F.col(c) for c in ("version", "calibration_time_ns", "valid_from_ns", "valid_to_ns")} | {c: F.col(c).cast("string") for c in ("calibration_id", "sensor_id")}
    own |= {"source": F.coalesce("source", F.lit("")), "intrinsic_model": F.nullif("intrinsic_model", F.lit(""))}
    error = F.lit(None).cast("string")
    for c, (key, needed) in CALIBRATION_PARTS.items():
        own[key] = F.try_parse_json(F.col(c))
        given = F.lit(True) if needed else F.coalesce(F.col(c) != "", F.lit(False))
        error = F.coalesce(error, F.when(given & own[key].isNull(), f"malformed {key}"))
    return F.when(error.isNull(), F.to_json(F.struct(*[own[k].alias(k) for k in sorted(own)]))), error


def read_calibration(text: Column) -> Column:
    """The columns of a calibration's document; focal lengths and principal point come out of its intrinsics."""
    v = F.try_parse_json(text)
    get = lambda path, kind: F.try_variant_get(v, path, kind)
    fields = {"calibration_id": "string", "sensor_id": "string", "version": "long", "calibration_time_ns": "long", "source": "string", "intrinsic_model": "string", "valid_from_ns": "long", "valid_to_ns": "long"}
    return F.struct(*[get(f"$.{k}", t).alias(k) for k, t in fields.items()], *[get(f"$.intrinsics.{k}", "double").alias(k) for k in ("fx", "fy", "cx", "cy")])


def feature_document(detector: Column, descriptor_type: Column, keypoints: Column, descriptors: Column) -> tuple[Column, Column]:
    """(text, error) of a feature artifact: key points (x, y, size, angle, response) and as many rows of descriptors, keys sorted. Null lists are errors too."""
    same = F.coalesce(F.size(keypoints) == F.size(descriptors), F.lit(False)) & keypoints.isNotNull()
    points = F.transform(keypoints, lambda p: F.struct(*[p[c].alias(c) for c in ("angle", "response", "size", "x", "y")]))
    doc = F.struct(
        F.size(keypoints).alias("count"), descriptor_type.alias("descriptor_type"), descriptors.alias("descriptors"), detector.alias("detector"), points.alias("keypoints"), F.lit(1).alias("schema_version"))
    return F.when(same, F.to_json(doc)), F.when(~same, "keypoints and descriptors differ in length")


def task_graph_json(tasks: DataFrame, edges: DataFrame, job: str = "job_id") -> DataFrame:
    """(job, graph): one document a job of its tasks and dependencies, sorted by id. One job's graph is one row."""
    t = tasks.groupBy(job).agg(F.array_sort(F.collect_list(F.struct("task_id", "status"))).alias("tasks"))
    e = edges.join(tasks.select(job, F.col("task_id").alias("child")), "child").groupBy(job).agg(F.array_sort(F.collect_set(F.struct("parent", "child"))).alias("dependencies"))
    out = t.join(e, job, "left")
    none = F.array().cast("array<struct<parent:bigint,child:bigint>>")
    return out.select(job, F.to_json(F.struct(F.coalesce("dependencies", none).alias("dependencies"), "tasks")).alias("graph"))


def read_task_graph(graphs: DataFrame, job: str = "job_id") -> tuple[DataFrame, DataFrame]:
    """(tasks, edges) of the documents of task_graph_json."""
    g = graphs.select(job, F.from_json("graph", "dependencies array<struct<parent long, child long>>, tasks array<struct<task_id long, status string>>").alias("g"))
    return g.select(job, F.inline("g.tasks")), g.select(job, F.inline("g.dependencies"))


def read_task_spec(text: Column) -> Column:
    """A task's specification (resources.cpu_cores, tool, inputs); null where the text is no JSON object."""
    return F.from_json(text, "resources struct<cpu_cores long>, tool string, inputs array<string>")
