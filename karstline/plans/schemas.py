"""JSON Schemas of documents of the engine, for operators.json_schema. Others can be read from their files by json.load."""

from __future__ import annotations

_UUID = {"type": "string", "format": "uuid"}


def _numbers(n: int) -> dict:
    return {"type": "array", "items": {"type": "number"}, "minItems": n, "maxItems": n}


# Keys, types, ranges and required keys of three document formats.
TRAJECTORY = {
    "type": "object", "additionalProperties": False, "required": ["schema_version", "trajectory_id", "nodes"],
    "properties": {"schema_version": {"const": 1}, "trajectory_id": _UUID, "nodes": {"type": "array", "items": {"$ref": "#/definitions/PoseNode"}}},
    "definitions": {"PoseNode": {
        "type": "object", "additionalProperties": False, "required": ["frame_id", "timestamp_ns", "sequence_index", "position_xyz", "rotation_xyzw"],
        "properties": {
            "frame_id": _UUID, "timestamp_ns": {"type": "integer"}, "sequence_index": {"type": "integer", "minimum": 0}, "position_xyz": _numbers(3), "rotation_xyzw": _numbers(4),
            "covariance_position": _numbers(6), "covariance_rotation": _numbers(6),
        },
    }},
}
_GROUPS = {"type": "object", "additionalProperties": {"type": "object"}}
QUALITY_REPORT = {
    "type": "object", "additionalProperties": False,
    "required": ["pipeline_hash", "stage_id", "quality_engine", "thresholds", "metrics", "quality_score", "verdict", "generated_at"],
    "properties": {
        "pipeline_hash": {"type": "string"}, "stage_id": {"type": "string"},
        "quality_engine": {"type": "object", "additionalProperties": False, "required": ["name", "version", "git_commit"], "properties": {k: {"type": "string"} for k in ("name", "version", "git_commit")}},
        "thresholds": _GROUPS, "metrics": _GROUPS, "quality_score": {"type": "number", "minimum": 0, "maximum": 100}, "verdict": {"type": "string", "enum": ["pass", "warn", "fail"]}, "generated_at": {"type": "string"},
    },
}
FEATURES = {
    "type": "object", "required": ["detector", "descriptor_type", "count", "keypoints", "descriptors", "schema_version"],
    "properties": {
        "detector": {"type": "string"}, "descriptor_type": {"type": "string"}, "count": {"type": "integer", "minimum": 0}, "schema_version": {"const": 1},
        "keypoints": {"type": "array", "items": {"type": "object", "required": ["x", "y"], "properties": {k: {"type": "number"} for k in ("x", "y", "size", "angle", "response")}}},
        "descriptors": {"type": "array", "items": {"type": "array", "items": {"type": "number"}}},
    },
}
