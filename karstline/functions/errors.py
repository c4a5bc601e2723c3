"""Stable error codes as a small dimension table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Codes and names; the thousands of a code tell its domain.
DOMAINS = "PROJECT STORAGE SCHEMA COORDINATE CALIBRATION IMPORT ARTIFACT SCHEDULER WORKER ADAPTER VALIDATION".split()
CODES = """
1001 PROJECT_INVALID
1002 PROJECT_NOT_FOUND
1003 PROJECT_CORRUPT
2001 STORAGE_CORRUPT
2002 STORAGE_READ_ONLY
2003 STORAGE_LOCK
2004 STORAGE_IO
2005 STORAGE_ATOMIC_WRITE
3001 SCHEMA_VERSION
3002 SCHEMA_MIGRATION
3003 SCHEMA_INVALID
4001 COORD_FRAME_MISMATCH
4002 COORD_FRAME_NOT_FOUND
4003 COORD_FRAME_CYCLE
4004 COORD_FRAME_DISCONNECTED
4005 COORD_FRAME_MULTIPLE_ROOTS
4006 COORD_FRAME_EXISTS
5001 CALIBRATION_INVALID
6001 IMPORT_UNREADABLE
6002 IMPORT_CORRUPT
6003 IMPORT_UNSUPPORTED_FORMAT
6004 IMPORT_MISSING_EXIF
6005 IMPORT_SENSOR_UNRESOLVED
6006 IMPORT_TIMESTAMP_UNRESOLVABLE
6007 IMPORT_VALIDATION_ERROR
7001 ARTIFACT_HASH_MISMATCH
7002 ARTIFACT_MISSING
7003 ARTIFACT_MANIFEST
7004 ARTIFACT_GC_CONFLICT
7005 ARTIFACT_UNREFERENCED
8001 SCHED_DAG_CYCLE
8002 SCHED_DAG_TYPE_MISMATCH
8003 SCHED_DAG_RESOURCE_INFEASIBLE
8004 SCHED_TASK_UNKNOWN
8005 SCHED_PERSISTENCE
8006 SCHED_CACHE_MISS
8007 SCHED_CANCELLED
9001 WORKER_PROTOCOL
9002 WORKER_HEARTBEAT_TIMEOUT
9003 WORKER_CRASHED
9004 WORKER_TERMINATED
9005 WORKER_BUSY
10001 ADAPTER_PROCESS_FAILED
10002 ADAPTER_PROCESS_TIMEOUT
10003 ADAPTER_PROCESS_CANCELLED
11001 VALIDATION_SCHEMA
11002 VALIDATION_DOMAIN
"""


def error_codes(spark: SparkSession) -> DataFrame:
    """code, name, domain of every stable error."""
    rows = [(int(c), name, DOMAINS[int(c) // 1000 - 1]) for c, name in map(str.split, CODES.split("\n")[1:-1])]
    return spark.createDataFrame(rows, "code int, name string, domain string")


def with_code(df: DataFrame, error: str, domain: str) -> DataFrame:
    """df with error_code and error_name of an error named by its words alone, as UnsupportedFormat in the domain IMPORT; unknown ones have neither."""
    codes = error_codes(df.sparkSession).where(F.col("domain") == domain)
    # the part of a name after its domain's prefix, without what parts words
    word = F.regexp_replace(F.regexp_replace("name", "^[A-Z]+_", ""), "_", "")
    codes = codes.select(word.alias("__w"), F.col("code").alias("error_code"), F.col("name").alias("error_name"))
    return df.withColumn("__w", F.upper(F.regexp_replace(error, "_", ""))).join(F.broadcast(codes), "__w", "left").drop("__w")
