"""Pipeline definitions and their compilation into a linear plan of tasks.

A plan has a few stages, so it is built on the driver; tables of tasks are made of it by `tables`.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Stage:
    id: str
    capability: str
    task_type: str
    inputs: tuple[str, ...]
    outputs: tuple[str, ...]


@dataclass(frozen=True)
class Pipeline:
    id: str
    version: str
    git_commit: str
    stages: tuple[Stage, ...]


#: The two pipelines that are built in.
BUILT_IN = {
    "mock_photogrammetry": (
        Stage("feature_extract", "feature_extraction", "feature_extract", ("image",), ("keypoints",)),
        Stage("reconstruct", "reconstruction", "reconstruct", ("keypoints",), ("point_cloud",)),
        Stage("validate", "validation", "validate", ("point_cloud",), ("quality_report",)),
    ),
    "feature_extraction": (Stage("feature_extract", "feature_extraction", "feature_extract", ("image",), ("feature",)),),
}


class Registry:
    """Pipelines by id; an id is registered once."""

    def __init__(self):
        self._known: dict[str, Pipeline] = {}

    def register(self, pipeline: Pipeline) -> None:
        if pipeline.id in self._known:
            raise ValueError(f"pipeline '{pipeline.id}' is registered already")
        self._known[pipeline.id] = pipeline

    def find(self, id_: str) -> Pipeline | None:
        return self._known.get(id_)

    def ids(self) -> list[str]:
        return sorted(self._known)


def built_in(version: str = "0.1.0", git_commit: str = "") -> Registry:
    out = Registry()
    for id_, stages in BUILT_IN.items():
        out.register(Pipeline(id_, version, git_commit, stages))
    return out


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def compile_pipeline(pipeline: Pipeline, inputs: list[str], config_json: str, capabilities: set[str], version: str = "", commit: str = "") -> dict:
    """Plan of a run: pipeline and configuration hashes, and per stage its inputs, output placeholder, canonical
    configuration, configuration hash and task hash. Raises ValueError before any task exists if there is no stage,
    no input, a broken configuration or a capability that no worker offers."""
    if not pipeline.stages:
        raise ValueError(f"pipeline '{pipeline.id}' has no stages")
    if not inputs:
        raise ValueError(f"pipeline '{pipeline.id}' requires at least one external input")
    try:
        config = json.loads(config_json) if config_json else {}
    except json.JSONDecodeError:
        raise ValueError("invalid pipeline configuration JSON") from None
    for s in pipeline.stages:
        if s.capability not in capabilities:
            raise ValueError(f"pipeline '{pipeline.id}': no worker advertises capability '{s.capability}' (stage '{s.id}')")
    config_hash = _sha(config_json)
    refs = "".join(f"{r}|" for r in sorted(inputs))
    stages, given = [], list(inputs)
    for s in pipeline.stages:
        text = json.dumps({"config": config, "pipeline_id": pipeline.id, "pipeline_version": pipeline.version, "stage": s.id}, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        key = "\n".join([s.task_type, *sorted(given), _sha(text), version, commit])
        placeholder = f"{pipeline.id}/{s.id}/output"
        stages.append({"stage_id": s.id, "task_type": s.task_type, "inputs": given, "output": placeholder, "config_json": text, "config_hash": _sha(text), "task_hash": _sha(key), "external": s is pipeline.stages[0]})
        given = [placeholder]
    whole = f"{pipeline.id}|{pipeline.version}|{pipeline.git_commit}|{config_hash}|{refs}"
    return {"pipeline_id": pipeline.id, "config_hash": config_hash, "pipeline_hash": _sha(whole), "stages": stages}


def tables(spark: SparkSession, plan: dict) -> tuple[DataFrame, DataFrame]:
    """(tasks, edges) of a plan, in the shape that the task operators take."""
    ids = [s["stage_id"] for s in plan["stages"]]
    tasks = [(s["stage_id"], s["task_type"], s["inputs"], [s["output"]], s["config_hash"], s["task_hash"], "pending") for s in plan["stages"]]
    kinds = "task_id string, type string, inputs array<string>, outputs array<string>, config_hash string, cache_key string, status string"
    return spark.createDataFrame(tasks, kinds), spark.createDataFrame(list(zip(ids, ids[1:])), "parent string, child string")
