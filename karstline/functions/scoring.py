"""Quality scores, verdicts, deterministic draws, backoff."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Default thresholds, weights and the reference error in pixels.
PASS, WARN = 80.0, 50.0
WEIGHTS = (0.5, 0.3, 0.2)
RMSE_REFERENCE = 1.5


def clamp01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def quality_score(rmse_px: Column, completeness_pct: Column, confidence: Column) -> Column:
    parts = (clamp01(1 - rmse_px / RMSE_REFERENCE), clamp01(completeness_pct / 100), clamp01(confidence))
    return sum(F.lit(100.0 * w) * p for w, p in zip(WEIGHTS, parts))


def thresholds(config: Column) -> Column:
    """Struct (pass, warn) from JSON text; anything missing or of another type falls back, pass is at least warn."""
    v = F.try_parse_json(config)
    get = lambda k, d: F.coalesce(
        F.when(F.schema_of_variant(F.try_variant_get(v, f"$.config.quality.thresholds.{k}", "variant")).rlike("^(BIGINT|DOUBLE|DECIMAL|FLOAT|INT)"),
               F.try_variant_get(v, f"$.config.quality.thresholds.{k}", "double")), F.lit(d))
    warn = get("warn", WARN)
    return F.struct(F.greatest(get("pass", PASS), warn).alias("pass"), warn.alias("warn"))


def verdict(score: Column, pass_at: Column, warn_at: Column) -> Column:
    return F.when(score >= pass_at, "pass").when(score >= warn_at, "warn").otherwise("fail")


def backoff(attempt: Column, base_ms, factor, most_ms) -> Column:
    return F.least(F.lit(base_ms) * F.pow(F.lit(float(factor)), attempt - 1), F.lit(float(most_ms)))


def _draws(seed: np.ndarray, n: int) -> np.ndarray:
    """n uniform doubles in [0, 1) of the splitmix64 stream of each seed."""
    with np.errstate(over="ignore"):
        z = seed[:, None] + np.uint64(0x9E3779B97F4A7C15) * np.arange(1, n + 1, dtype=np.uint64)[None, :]
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z ^= z >> np.uint64(31)
    return (z >> np.uint64(11)).astype(np.float64) / 2.0**53


METRICS = T.StructType([T.StructField(f"{c}", T.DoubleType()) for c in ("rmse_px", "mean_error_px", "completeness_pct", "baseline_ratio", "point_count", "mean_confidence")])


@F.pandas_udf(METRICS)
def mock_metrics(digest: pd.Series) -> pd.DataFrame:
    """Metrics drawn from the first 16 hex digits of a run seed; the mean error takes no draw."""
    u = _draws(np.array([int(x[:16], 16) for x in digest], np.uint64), 5)
    rmse = 0.2 + 1.3 * u[:, 0]
    return pd.DataFrame(
        {"rmse_px": rmse, "mean_error_px": 0.7 * rmse, "completeness_pct": 80 + 20 * u[:, 1], "baseline_ratio": 0.2 + 0.3 * u[:, 2],
         "point_count": 30000 + 30000 * u[:, 3], "mean_confidence": 0.5 + 0.5 * u[:, 4]}
    )


POINT = T.StructType([T.StructField(c, T.DoubleType()) for c in ("x", "y", "size", "angle", "response")])
FEATURES = T.StructType([T.StructField("keypoints", T.ArrayType(POINT)), T.StructField("descriptors", T.ArrayType(T.ArrayType(T.DoubleType())))])


def keypoints(digests: list[str], count: int) -> list[list[tuple]]:
    """Key points and 16 numbers each of a xorshift64* stream seeded by the exclusive or of a digest's 8-character words:
    a grid over 96 units with jitter. All digests of a batch are drawn together."""
    words = np.frombuffer("".join(digests).encode(), ">u8").reshape(len(digests), -1)
    state = np.bitwise_xor.reduce(words.astype(np.uint64), axis=1) if len(digests) else np.zeros(0, np.uint64)
    state = np.where(state == 0, np.uint64(0x9E3779B97F4A7C15), state)

    def draw(modulus: int) -> np.ndarray:
        nonlocal state
        with np.errstate(over="ignore"):
            state = state ^ (state >> np.uint64(12))
            state = state ^ (state << np.uint64(25))
            state = state ^ (state >> np.uint64(27))
            return (state * np.uint64(0x2545F4914F6CDD1D) % np.uint64(modulus)).astype(np.float64)

    side = int(np.ceil(np.sqrt(count)))
    space, out = 96.0 / side, []
    for i in range(count):
        x = (i % side) * space + draw(1000) / 1000.0 * space * 0.25
        y = (i // side) * space + draw(1000) / 1000.0 * space * 0.25
        point = [x, y, 2.0 + draw(1000) / 1000.0 * 4.0, draw(62831) / 100.0, draw(100000) / 100000.0]
        out.append((np.stack(point, axis=1), np.stack([draw(65536) / 65536.0 for _ in range(16)], axis=1)))
    return [[(tuple(p[k].tolist()), d[k].tolist()) for p, d in out] for k in range(len(digests))]


@F.pandas_udf(FEATURES)
def mock_keypoints(digest: pd.Series, count: pd.Series) -> pd.DataFrame:
    """Features of the SHA-256 (hex) of an image; counts outside 1 to 4096 read as 64."""
    count = count.where(count.between(1, 4096), 64).astype(int)
    got: dict = {}
    for n in count.unique():
        at = digest.index[count == n]
        got |= dict(zip(at, keypoints(digest[at].tolist(), int(n))))
    names = ("x", "y", "size", "angle", "response")
    rows = [got[i] for i in digest.index]
    return pd.DataFrame({"keypoints": [[dict(zip(names, p)) for p, _ in r] for r in rows], "descriptors": [[d for _, d in r] for r in rows]})
