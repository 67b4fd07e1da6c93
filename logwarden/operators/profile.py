"""Robust baseline profile of the rule features and the shadow score against it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..fixed_values import MAD_FACTOR, PROFILE_FEATURES, PROFILE_SCALE_FLOORS, PROFILE_THRESHOLD
from .quantiles import medians


def fit_profile(df: DataFrame, features: tuple[str, ...] = PROFILE_FEATURES, floors: dict | None = None) -> DataFrame:
    """One row: centre (median) and scale (floored MAD) per feature, and the window count.

    Medians are exact (``quantiles``), in passes that hold a bounded number of values. Without rows centres are null
    and scales the floors.
    """
    floors = PROFILE_SCALE_FLOORS if floors is None else floors
    centers, counts = medians(df, {f: F.col(f) for f in features})
    known = {f: c for f, c in centers.items() if c is not None}
    spread, _ = medians(df, {f: F.abs(F.col(f).cast("double") - F.lit(c)) for f, c in known.items()}) if known else ({}, {})
    scales = {f: max(float(floors[f]), spread[f] * MAD_FACTOR) if f in known else float(floors[f]) for f in features}
    names = ["normal_windows long", *[f"{kind}_{f} double" for f in features for kind in ("center", "scale")]]
    row = (max(counts.values()), *[x for f in features for x in (centers[f], scales[f])])
    return df.sparkSession.createDataFrame([row], ", ".join(names))


def valid_features() -> Column:
    """Three finite non-negative numbers, the reputation score not above 1."""
    ok = F.lit(True)
    for f in PROFILE_FEATURES:
        value = F.col(f).cast("double")
        ok = ok & value.isNotNull() & ~F.isnan(value) & (value >= 0) & (value < float("inf"))
    return F.coalesce(ok & (F.col("ip_reputation_score") <= 1), F.lit(False))


def score_profile(df: DataFrame, profile: DataFrame | None, dropped: str | None = "dropped") -> DataFrame:
    """Add shadow_status, shadow_reason, shadow_score, shadow_anomaly and shadow_top_feature.

    Dropped events are skipped; a missing profile or bad features make the verdict unavailable.
    """
    skipped = F.col(dropped).cast("boolean") if dropped and dropped in df.columns else F.lit(False)
    if profile is None:
        status = F.when(skipped, "skipped").otherwise("unavailable")
        return df.withColumns(
            {
                "shadow_status": status,
                "shadow_reason": F.when(skipped, "blocked_event").otherwise("profile_missing"),
                "shadow_score": F.lit(None).cast("double"),
                "shadow_anomaly": F.lit(None).cast("boolean"),
                "shadow_top_feature": F.lit(None).cast("string"),
            }
        )
    joined = df.withColumn("__profile", profile.select(F.struct("*")).scalar())
    deviation = {
        f: F.greatest(F.lit(0.0), F.col(f).cast("double") - F.col(f"__profile.center_{f}")) / (F.lit(3.0) * F.col(f"__profile.scale_{f}"))
        for f in PROFILE_FEATURES
    }
    top = F.greatest(*deviation.values())
    first = F
    for f, d in deviation.items():
        first = first.when(d == top, f)
    scored = valid_features() & ~skipped
    out = joined.withColumns(
        {
            "shadow_status": F.when(skipped, "skipped").when(scored, "scored").otherwise("unavailable"),
            "shadow_reason": F.when(skipped, "blocked_event").when(~scored, "invalid_features"),
            "shadow_score": F.when(scored, F.bround(top, 4)),
            "shadow_anomaly": F.when(scored, top > PROFILE_THRESHOLD),
            "shadow_top_feature": F.when(scored, first),
        }
    )
    return out.drop("__profile")
