"""Content-addressed artifacts, snapshots and mutations as functions from DataFrame to DataFrame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def put(index: DataFrame, incoming: DataFrame, hash_col: str = "content_hash") -> tuple[DataFrame, DataFrame]:
    """(rows to append, incoming with flag dedup): content that is known, or came earlier in the batch by seq, is not written again."""
    # the first of each content is found before anything is joined, so a payload that a third of all rows hold is not sorted by one task
    first = incoming.groupBy(hash_col).agg(F.min("seq").alias("__first"))
    first = first.join(index.select(hash_col).distinct().withColumn("__hit", F.lit(True)), hash_col, "left")
    marked = incoming.join(first, hash_col)
    marked = marked.withColumn("dedup", F.coalesce("__hit", F.lit(False)) | (F.col("seq") > F.col("__first"))).drop("__hit", "__first")
    return marked.where("not dedup").drop("dedup"), marked


def keep_last(df: DataFrame, keys: list[str], seq: str = "seq") -> DataFrame:
    """The row of each key that was written last."""
    w = Window.partitionBy(*keys).orderBy(F.col(seq).desc())
    return df.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def artifact_index(writes: DataFrame, seq: str = "seq") -> DataFrame:
    """Replace on id or content hash: a row stays if no later write has its id or its hash. Both are
    judged on the whole log, since a write that is itself replaced has replaced others before."""
    last = writes.withColumn("__i", F.max(seq).over(Window.partitionBy("artifact_id"))).where(F.col(seq) == F.col("__i"))
    # A row that is its id's last is dropped if any write, kept or not, has its hash later.
    top = writes.groupBy("content_hash").agg(F.max(seq).alias("__h"))
    return last.join(top, "content_hash").where(F.col(seq) == F.col("__h")).select(*writes.columns)


def verify(files: DataFrame, name: Column) -> DataFrame:
    """Stored files whose bytes no longer hash to their name."""
    return files.where(F.sha2("content", 256) != name)


def quarantine(index: DataFrame, corrupt: DataFrame, key: str = "content_hash") -> DataFrame:
    """The index with validation_status 'degraded' where the payload failed verify()."""
    hit = corrupt.select(key).distinct().withColumn("__hit", F.lit(True))
    status = F.when(F.col("__hit"), "degraded").otherwise(F.col("validation_status"))
    return index.join(hit, key, "left").withColumn("validation_status", status).drop("__hit").select(*index.columns)


def put_instance(stored: DataFrame, asked: DataFrame, key: str = "content_hash") -> tuple[DataFrame, DataFrame]:
    """(new instances of payloads that are stored, requests refused because theirs is missing)."""
    have = stored.select(key).distinct()
    return asked.join(have, key, "left_semi"), asked.join(have, key, "left_anti")


def dangling(manifests: DataFrame, index: DataFrame, key: str) -> DataFrame:
    """Manifests that the index does not hold."""
    return unreferenced(manifests, index, key)


def unreferenced(stored: DataFrame, index: DataFrame, key: str) -> DataFrame:
    """What a collection would delete: stored keys that the index does not hold."""
    return stored.join(index.select(key).distinct(), key, "left_anti")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], keep: list[str] | None = None, seq: str | None = None) -> DataFrame:
    """Next snapshot: rows of new replace rows of old by keys; columns in keep retain the old value where there is one.
    Of several new rows of a key the last by seq counts; without seq, the greatest by all columns."""
    new = _once(new, keys, seq)
    stay = old.join(new.select(*keys), keys, "left_anti")
    if keep:
        prior = old.select(*keys, *[F.col(c).alias(f"__{c}") for c in keep])
        new = new.join(prior, keys, "left").withColumns({c: F.coalesce(f"__{c}", c) for c in keep}).drop(*[f"__{c}" for c in keep])
    return stay.unionByName(new.select(*old.columns))


def _once(df: DataFrame, keys: list[str], seq: str | None) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    order = F.struct(*([F.col(seq).alias("__seq")] if seq else []), *rest)
    return df.groupBy(*keys).agg(F.max(order).alias("__r")).select(*keys, *[F.col(f"__r.{c}").alias(c) for c in rest]) if rest else df.distinct()


def append_unique(old: DataFrame, new: DataFrame, keys: list[str], seq: str) -> tuple[DataFrame, DataFrame]:
    """(next snapshot, refused rows) of rows added one after another in the order of `seq`, which tells the rows of a key apart: a key that is
    there already is refused, of several new rows of a key the first comes in."""
    first = new.groupBy(*keys).agg(F.min(seq).alias("__first"))
    first = first.join(old.select(*keys).distinct().withColumn("__hit", F.lit(True)), keys, "left")
    marked = new.join(first, keys)
    bad = F.coalesce("__hit", F.lit(False)) | (F.col(seq) > F.col("__first"))
    return old.unionByName(marked.where(~bad).select(*old.columns)), marked.where(bad).select(*new.columns)


def update_fields(old: DataFrame, changes: DataFrame, key: str, seq: str | None = None) -> DataFrame:
    """Set the columns of changes; '' clears a value. Unknown keys change nothing (see missing). Of several
    changes of a key the last by seq counts; without seq, the greatest by all columns."""
    changes = _once(changes, [key], seq)
    names = [c for c in changes.columns if c not in (key, seq)]
    hit = changes.select(key, *[F.col(c).alias(f"__{c}") for c in names]).withColumn("__hit", F.lit(True))
    out = old.join(hit, key, "left")
    return out.withColumns({c: F.when(F.col("__hit"), F.nullif(F.col(f"__{c}"), F.lit(""))).otherwise(F.col(c)) for c in names}).select(*old.columns)


def missing(keys: DataFrame, table: DataFrame, key: str) -> DataFrame:
    return keys.join(table.select(key).distinct(), key, "left_anti")


def new_scene_versions(scenes: DataFrame, versions: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(versions, scenes, refused) after one new version for each request(scene_id, version_id, created_at_ns), in
    order of time, then version: the parent is the scene's current one, which then moves. Requests for unknown scenes are refused."""
    w = Window.partitionBy("scene_id").orderBy("created_at_ns", "version_id")
    before = F.lag("version_id").over(w)
    known = requests.join(scenes.select("scene_id", F.col("current_version").alias("__now")), "scene_id")
    fresh = known.withColumn("parent_version", F.coalesce(before, F.col("__now")))
    last = known.groupBy("scene_id").agg(F.max(F.struct("created_at_ns", "version_id")).alias("__v"))
    moved = scenes.join(last, "scene_id", "left").withColumn("current_version", F.coalesce("__v.version_id", "current_version"))
    refused = requests.join(scenes.select("scene_id"), "scene_id", "left_anti")
    return versions.unionByName(fresh.select(*versions.columns)), moved.select(*scenes.columns), refused


def find_or_create_scenes(scenes: DataFrame, projects: DataFrame, new_id: Column, created_at: Column | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(scene_id of each project, scenes to append, versions to append): a project's open scene with the smallest id, else a new one with its first version,
    which is the new scene's current one. A version's id is its scene's id and ':1'."""
    have = scenes.where("status = 'open'").groupBy("project_id").agg(F.min("scene_id").alias("__s"))
    out = projects.join(have, "project_id", "left")
    every = out.select("project_id", F.coalesce("__s", new_id).alias("scene_id"), F.col("__s").isNull().alias("created"))
    fresh = every.where("created")
    first = F.concat(F.col("scene_id").cast("string"), F.lit(":1"))
    at = created_at if created_at is not None else F.lit(0).cast("long")
    versions = fresh.select(first.alias("version_id"), "scene_id", F.lit(1).cast("long").alias("version"), F.lit(None).cast("string").alias("parent_version"), at.alias("created_at_ns"))
    return every, fresh.select("scene_id", "project_id", F.lit("open").alias("status"), first.alias("current_version")), versions


def collect_garbage(stored: DataFrame, index: DataFrame, key: str, dry_run: bool = False) -> tuple[DataFrame, DataFrame]:
    """(what stays, what goes) of stored payloads that the index does not hold; a dry run keeps all and only says what would go."""
    gone = unreferenced(stored, index, key)
    return (stored if dry_run else stored.join(index.select(key).distinct(), key, "left_semi")), gone


def manifest_json(df: DataFrame) -> Column:
    """JSON of a manifest row with sorted keys; config_hash is written as configuration_hash, null where it is empty, and stays in the text."""
    cols = {c: F.col(c) for c in df.columns if c != "config_hash"} | {"configuration_hash": F.nullif(F.col("config_hash"), F.lit(""))}
    return F.to_json(F.struct(*[cols[c].alias(c) for c in sorted(cols)]), {"ignoreNullFields": "false"})
