"""Row validators: rules give the violations of a table as rows (rule, key)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HASH = "^[0-9a-f]{64}$"


def violations(df: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """One row a broken rule and row, in one pass; an unknown outcome counts as broken."""
    hit = F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()])
    return df.select(F.col(key), F.explode(F.filter(hit, lambda x: x.isNotNull())).alias("rule"))


def sized(col: str, n: int) -> Column:
    return F.size(col) == n


def within(col: str, lo: float, hi: float) -> Column:
    return F.col(col).between(lo, hi)


def finite(col: str) -> Column:
    return F.forall(col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def pose_node_rules() -> dict[str, Column]:
    return {"position": sized("position_xyz", 3) & finite("position_xyz"), "rotation": sized("rotation_xyzw", 4) & finite("rotation_xyzw"),
            "covariance": F.col("covariance_position").isNull() | sized("covariance_position", 6)}


def edge_rules() -> dict[str, Column]:
    return {"information": F.col("information_matrix_6x6").isNull() | sized("information_matrix_6x6", 36), "confidence": within("confidence", 0, 1), "hash": F.col("content_hash").rlike(HASH)}


def unique(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def foreign(df: DataFrame, col: str, table: DataFrame, key: str) -> DataFrame:
    return df.where(F.col(col).isNotNull()).join(table.select(F.col(key).alias(col)).distinct(), col, "left_anti")
