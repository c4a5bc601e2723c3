"""Table records: inserts under keys and references, and logs of writes replayed to their last state."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import identity as ids
from . import documents, store


@dataclass(frozen=True)
class Reference:
    """column of the inserted rows refers to `key` of parents; an optional one may be null."""

    column: str
    parents: DataFrame
    key: str
    optional: bool = False


def insert_rows(old: DataFrame, new: DataFrame, keys: list[str], seq: str, references: Sequence[Reference] = ()) -> tuple[DataFrame, DataFrame]:
    """(next table, refused rows with reason) of rows added one after another in the order of `seq`, which tells rows apart.

    'null': a key or a reference that must be there is null. 'exists': the key is there, or an earlier row that came in has it. 'reference': no parent has
    the value. A refused row takes nothing, so a later row may have its key. Keys are reduced to their first good row before anything is joined back."""
    rows, good = new, F.lit(True)
    lacking = F.lit(False)
    for i, r in enumerate(references):
        # rows that name no parent are dealt by their place, else all of them would come to one task; for all others both sides have 0
        zero = lambda c: F.pmod(F.xxhash64(c), F.lit(1).cast("long"))
        have = r.parents.where(F.col(r.key).isNotNull()).select(F.col(r.key).alias(f"__key{i}")).distinct()
        have = have.withColumns({f"__ref{i}": F.lit(True), f"__zero{i}": zero(F.col(f"__key{i}"))})
        rows = rows.withColumn(f"__deal{i}", F.when(F.col(r.column).isNull(), F.xxhash64(seq)).otherwise(zero(F.col(r.column))))
        rows = rows.join(have, (F.col(r.column) == F.col(f"__key{i}")) & (F.col(f"__deal{i}") == F.col(f"__zero{i}")), "left").drop(f"__key{i}", f"__zero{i}", f"__deal{i}")
        good &= F.col(f"__ref{i}").isNotNull() | (F.col(r.column).isNull() & F.lit(r.optional))
        if not r.optional:
            lacking |= F.col(r.column).isNull()
    for k in keys:
        lacking |= F.col(k).isNull()
    rows = rows.select(*new.columns, (good & ~lacking).alias("__good"), lacking.alias("__null"))
    first = rows.where("__good").groupBy(*keys).agg(F.min(seq).alias("__first"))
    there = old.select(*keys).distinct().withColumn("__there", F.lit(True))
    marked = rows.join(first, keys, "left").join(there, keys, "left")
    taken = F.col("__there").isNotNull() | F.coalesce(F.col("__first") < F.col(seq), F.lit(False))
    marked = marked.withColumn("reason", F.when(F.col("__null"), "null").when(taken, "exists").when(~F.col("__good"), "reference"))
    return old.unionByName(marked.where("reason is null").select(*old.columns)), marked.where("reason is not null").select(*new.columns, "reason")


def replay_entries(log: DataFrame, key: str, seq: str, op: str = "op") -> DataFrame:
    """What a log of 'upsert' and 'delete' leaves: the last write of each key, unless it is a delete. Only a row a key and task travels."""
    rest = [c for c in log.columns if c not in (key, seq, op)]
    last = log.groupBy(key).agg(F.max(F.struct(seq, op, *rest)).alias("__w"))
    return last.where(F.col(f"__w.{op}") == "upsert").select(key, *[F.col(f"__w.{c}").alias(c) for c in rest])


def replay_manifests(log: DataFrame, seq: str) -> tuple[DataFrame, DataFrame]:
    """(manifests, stages) that a log of writes leaves.

    log(seq, op, manifest_id, sequence, stage_id, status, cache_hit, at_ns, report_id): 'begin' makes a manifest ('running', created at at_ns; a second one of its
    id is refused), 'stage' a stage of one that is there ('pending', the first of a sequence comes in), 'update' sets a stage's status, cache_hit and
    finished_at_ns, 'finish' a manifest's status and finished_at_ns, 'report' its quality report. A write to what is not there yet changes nothing; of several the last counts."""
    op, at = F.col("op"), F.col(seq)
    begun = log.where("op = 'begin'").groupBy("manifest_id").agg(F.min(F.struct(at.alias("s"), "at_ns")).alias("b"))
    known = log.where("op <> 'begin'").join(begun, "manifest_id").where(at > F.col("b.s"))
    ends = known.where("op in ('finish', 'report')").groupBy("manifest_id").agg(
        F.max(F.when(op == "finish", F.struct(at, "status", "at_ns"))).alias("f"), F.max(F.when(op == "report", F.struct(at, "report_id"))).alias("r"))
    manifests = begun.join(ends, "manifest_id", "left").select(
        "manifest_id", F.when(F.col("f").isNotNull(), F.col("f.status")).otherwise("running").alias("status"), F.col("b.at_ns").alias("created_at_ns"),
        F.col("f.at_ns").alias("finished_at_ns"), F.col("r.report_id").alias("quality_report_id"))
    place = ["manifest_id", "sequence"]
    made = known.where("op = 'stage' and sequence is not null").groupBy(*place).agg(F.min(F.struct(at.alias("s"), "stage_id")).alias("m"))
    last = known.where("op = 'update'").drop("b").join(made, place).where(at > F.col("m.s")).groupBy(*place).agg(F.max(F.struct(at, "status", "cache_hit", "at_ns")).alias("u"))
    done = F.col("u").isNotNull()
    stages = made.join(last, place, "left").select(
        *place, F.col("m.stage_id").alias("stage_id"), F.when(done, F.col("u.status")).otherwise("pending").alias("status"),
        F.when(done, F.col("u.cache_hit")).otherwise(False).alias("cache_hit"), F.col("u.at_ns").alias("finished_at_ns"))
    return manifests, stages


def record_features(index: DataFrame, feature_sets: DataFrame, batch: DataFrame) -> DataFrame:
    """One row for each of batch(seq, frame_id, detector, descriptor_type, keypoints, descriptors): feature_set_id, content_hash, count, document, payload_stored
    (known in index(content_hash), or earlier in the batch), record_exists (in feature_sets(feature_set_id), or earlier in the batch) and error.

    An identifier follows from frame and content, so a second run over the same images writes nothing. A row in error has only its error."""
    text, error = documents.feature_document(F.col("detector"), F.col("descriptor_type"), F.col("keypoints"), F.col("descriptors"))
    rows = batch.select("seq", "frame_id", F.size("keypoints").alias("count"), text.alias("document"), error.alias("error"))
    hashed = rows.withColumn("content_hash", ids.sha256(F.col("document")))
    sound = hashed.where("error is null").withColumn("feature_set_id", ids.feature_set_id(F.col("frame_id").cast("string"), F.col("content_hash")))
    _, marked = store.put(index, sound)
    marked = marked.withColumnRenamed("dedup", "payload_stored")
    _, marked = store.put(feature_sets, marked, "feature_set_id")
    bad = hashed.where("error is not null").select("seq", "frame_id", "error")
    return marked.withColumnRenamed("dedup", "record_exists").unionByName(bad, allowMissingColumns=True)
