"""Scale run at the reference's data size: a per-minute panel of 80 entities x
129,600 minutes (90 days, 10.37 M rows) built with ``spark.range``, then the
serving job's stages with the reference's parameters (trend 60 rows, horizon
720 rows, forest of 100 trees / depth 14 on a 300k-row sample, last 3 days
scored, 15-minute bins). Not a registered query: it measures the engine on
synthetic input; correctness is covered by the oracle queries and tests.

Usage: python tools/scale_panel.py [scratch_dir]   (prints one JSON line)
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

ENTITIES, MINUTES = 80, 129_600


def synthetic_panel(spark):
    """Deterministic signals with per-entity levels, daily rhythm, noise,
    episodes of raised heart rate and ~0.5 % missing minutes."""
    from pyspark.sql import functions as F

    def u(col, salt):  # uniform [0, 1) from a hash
        return (F.abs(F.xxhash64(col, F.lit(salt))) % 1_000_003) / F.lit(1_000_003.0)

    r = spark.range(ENTITIES * MINUTES)
    e = (F.col("id") / MINUTES).cast("long")
    m = F.col("id") % MINUTES
    day = F.sin(2 * 3.141592653589793 * (m % 1440) / 1440.0)
    episode = (u(e * 1000 + (m / 720).cast("long"), 7) < 0.08).cast("double")
    df = r.select(e.alias("user_id"), F.timestamp_seconds(F.lit(1_704_067_200) + m * 60).alias("received_date"),
                  (60 + 10 * u(e, 1) + 8 * day + 6 * u(F.col("id"), 2) + 25 * episode).alias("heart_rate"),
                  (40 + 15 * u(e, 3) - 5 * day + 8 * u(F.col("id"), 4) - 10 * episode).alias("heart_rate_variability"),
                  (97 + 1.5 * u(F.col("id"), 5) - 2 * episode).alias("spo2"),
                  ((m % 1440) * 3 * u(e, 6)).alias("steps"),
                  (14 + 2 * day + 2 * u(F.col("id"), 8) + 4 * episode).alias("respirations_per_minute"),
                  ((m % 1440) * 2.1 * u(e, 6)).alias("distance"),
                  (70 - 30 * day - 20 * episode + 5 * u(F.col("id"), 9)).alias("body_battery"),
                  u(F.col("id"), 10).alias("_drop"))
    return df.filter(F.col("_drop") >= 0.005).drop("_drop")


def main() -> None:
    from vitalgrid.operators import grid as G
    from vitalgrid.operators import models as MD
    from vitalgrid.operators import serving as V
    from vitalgrid.operators.features import build_features, feature_columns
    from vitalgrid.operators.filters import recent_window
    from vitalgrid.operators.splits import split_by_entity
    from vitalgrid.session import build_session, materialize
    from vitalgrid.sources.io import WEARABLE_SIGNALS

    scratch = sys.argv[1] if len(sys.argv) > 1 else tempfile.mkdtemp(prefix="vitalgrid-scale-")
    spark = build_session(master="local[8]", shuffle_partitions=64, app_name="vitalgrid-scale",
                          extra={"spark.checkpoint.dir": os.path.join(scratch, "ckpt")})
    times: dict[str, float] = {}

    def run(name, fn):
        t0 = time.perf_counter()
        res = fn()
        times[name] = round(time.perf_counter() - t0, 3)
        return res

    src = os.path.join(scratch, "panel")
    synthetic_panel(spark).write.mode("overwrite").parquet(src)        # input file, not timed
    E, T, SIG = "user_id", "received_date", WEARABLE_SIGNALS
    raw = spark.read.parquet(src)
    raw.groupBy(E).count().write.format("noop").mode("overwrite").save()   # warm-up, not timed
    clean = run("load_clean_grid", lambda: materialize(
        G.clean_panel(raw, E, T, SIG, "1 minute", limit=5, row_number="rn"), "scale-clean"))
    n_rows = clean.count()
    feats = run("features_labels", lambda: materialize(
        build_features(clean.select(E, T, "rn", *SIG), E, [T], SIG, z_threshold=2.0, trend_rows=60, horizon=720,
                       rn="rn"),
        "scale-features"))
    cols = feature_columns(SIG, trend=True)
    y = "target_future_risk"
    train, test = split_by_entity(feats, E, 0.25, seed=42)
    sample = run("sample_300k", lambda: materialize(_sample(train, E, T, 300_000), "scale-sample"))
    model = run("rf_train", lambda: MD.fit_forest(sample, cols, y, num_trees=100, max_depth=14))
    recent = run("recent_3_days", lambda: materialize(recent_window(feats, E, T, 3), "scale-recent"))
    n_recent = recent.count()
    scored = run("risk_uncertainty", lambda: materialize(MD.tree_uncertainty(model, recent, cols), "scale-scored"))
    imp = MD.signal_importance(model, cols, SIG, exclude=("steps", "distance"))
    expl = run("explain", lambda: materialize(
        V.top_k_factors(scored, {s: f"{s}_zscore" for s in imp}, imp, k=3), "scale-explained"))
    out = os.path.join(scratch, "serving")
    factors = ["top_factor_1", "top_factor_2", "top_factor_3"]
    run("downsample_write", lambda: V.downsample(expl.select(E, T, *SIG, "risk_score", "uncertainty", *factors),
                                                 E, T, "15 minutes", [*SIG, "risk_score", "uncertainty"], factors)
        .write.mode("overwrite").parquet(out))
    n_out = spark.read.parquet(out).count()
    print(json.dumps({"metric": "total_sec", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "rows_grid": n_rows, "rows_recent": n_recent, "rows_serving": n_out,
                      "entities": ENTITIES, "minutes": MINUTES}))
    spark.stop()


def _sample(train, entity, ts, n):
    """``n`` training rows by the seeded hash of (entity, minute)."""
    from pyspark.sql import functions as F

    from vitalgrid.operators.splits import sample_n
    keyed = train.withColumn("_key", F.concat_ws(":", F.col(entity).cast("string"),
                                                  F.unix_seconds(F.col(ts)).cast("string")))
    return sample_n(keyed, "_key", n, seed=42).drop("_key")


if __name__ == "__main__":
    main()
