"""Model queries (rows-only checks: fits are iterative and not SQL).

Input: the P-raw panel -> ``build_features`` with the fixture horizons
(trend 5 rows, horizon 6 rows; FIXTURES.md §3) -> split by entity (seed 42).
The feature table is written once under ``spark.checkpoint.dir``
(``session.materialize``) before the fits, so every fit and every scoring pass
reads it instead of recomputing the window plan, and a lost executor does not
replay the lineage.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalgrid.operators import models as MD
from vitalgrid.operators.baselines import entity_stats, zscore
from vitalgrid.operators.features import build_features, derived_columns, feature_columns, impute_entity_mean
from vitalgrid.functions.scalar import any_exceeds_expr
from vitalgrid.operators.splits import sample_n, split_by_entity
from vitalgrid.operators.trees import NODES, ensemble
from vitalgrid.plans.common import auroc_sql, flag_sql
from vitalgrid.plans.registry import query, rounded
from vitalgrid.session import materialize
from vitalgrid.sources import fixtures as X

E, ORD = "user_id", ["ts", "event_id"]
SIG = X.P_RAW_SIGNALS
Y = "target_future_risk"
COLS14 = feature_columns(SIG, trend=False)   # raw + z (baselines)
COLS21 = feature_columns(SIG, trend=True)    # raw + z + trend (final model)


# Labelled rows that tree models and the search are fitted on, at most.
TREE_ROWS = 300_000
SEARCH_ROWS = 150_000
SEARCH_DRAWS, SEARCH_FOLDS = 15, 3
#: Rows of a bounded training sample in one file: a fit reads it many times.
FILE_ROWS = 50_000


def labelled(spark, d, sustained: bool = False) -> DataFrame:
    p = X.p_raw(spark, d)
    if sustained:
        f = build_features(p, E, ORD, SIG, z_threshold=1.0, trend_rows=5, horizon=6, sustained_rows=2)
    else:
        f = build_features(p, E, ORD, SIG, z_threshold=2.0, trend_rows=5, horizon=6)
    return materialize(impute_entity_mean(f, E, SIG), "features")


def train_test(spark, d, sustained: bool = False):
    f = labelled(spark, d, sustained)
    return split_by_entity(f, E, 0.25, seed=42)


def training_rows(train: DataFrame, n: int | None = TREE_ROWS) -> DataFrame:
    """The seeded sample that tree models are fitted on (all rows up to ``n``; None: all rows)."""
    if n is None:
        return materialize(train, "training-rows", partitions=-(-max(TREE_ROWS, train.count()) // FILE_ROWS))
    sample = sample_n(train, [E, "event_id"], n, seed=42)
    return materialize(sample, "training-rows", partitions=-(-n // FILE_ROWS))


@query("build_features", flag_sql(2.0) + """
SELECT user_id, event_id, round(value, 6) AS value, round(k, 6) AS k, round(value_zscore, 6) AS value_zscore,
       round(k_zscore, 6) AS k_zscore, round(avg(value_zscore) OVER w, 6) AS value_zscore_trend,
       round(avg(k_zscore) OVER w, 6) AS k_zscore_trend, risk_event_now,
       CAST(coalesce(max(CAST(risk_event_now AS INTEGER)) OVER (PARTITION BY user_id ORDER BY ts, event_id
            ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING), 0) AS INTEGER) AS target_future_risk
FROM flagged WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)""")
def q_build_features(spark, d):
    """The labelled feature table (z, trend, event flag, 6-row look-ahead label)."""
    p = X.p_raw(spark, d)
    return rounded(build_features(p, E, ORD, SIG, z_threshold=2.0, trend_rows=5, horizon=6).select(
        E, "event_id", *COLS21, "risk_event_now", Y))


@query("fit_logistic")
def q_fit_logistic(spark, d):
    """B2: balanced L2 logistic regression on raw + z; test-entity scores."""
    train, test = train_test(spark, d)
    m = MD.fit_logistic(train, COLS14, Y)
    return rounded(MD.score(m, test, COLS14).select(E, "event_id", Y, "risk_score"))


@query("fit_forest")
def q_fit_forest(spark, d):
    """B3: balanced forest, 50 trees, depth 12; test-entity scores."""
    train, test = train_test(spark, d)
    m = MD.fit_forest(training_rows(train), COLS14, Y, num_trees=50, max_depth=12)
    return rounded(MD.score(m, test, COLS14).select(E, "event_id", Y, "risk_score"))


@query("fit_boosting")
def q_fit_boosting(spark, d):
    """B5: boosted trees, 150 iterations, balanced weights; test-entity scores."""
    train, test = train_test(spark, d)
    m = MD.fit_boosting(training_rows(train), COLS14, Y, max_iter=150)
    return rounded(MD.score(m, test, COLS14).select(E, "event_id", Y, "risk_score"))


def final_forest(train: DataFrame):
    """The final forest: 100 trees, depth 14, raw + z + trend features."""
    return MD.fit_forest(training_rows(train), COLS21, Y, num_trees=100, max_depth=14)


def final_scores(spark, d):
    train, test = train_test(spark, d)
    m = final_forest(train)
    return m, MD.tree_uncertainty(m, test, COLS21)


@query("tree_uncertainty")
def q_tree_uncertainty(spark, d):
    """Final forest (100 trees, depth 14, trend features): risk and per-tree spread."""
    _, s = final_scores(spark, d)
    return rounded(s.select(E, "event_id", Y, "risk_score", "uncertainty"))


@query("uncertainty_summary")
def q_uncertainty_summary(spark, d):
    """Mean, min and max of the per-tree spread on the test entities, with
    AUROC, PR-AUC and Brier of the final forest."""
    from vitalgrid.operators.metrics import brier, uncertainty_summary
    _, s = final_scores(spark, d)
    s = materialize(s, "scored")
    u = uncertainty_summary(s)
    ev = MD.evaluate(s, Y, "final")
    return rounded(side_by_side(ev, u, brier(s, "risk_score", Y)))


def side_by_side(*ones: DataFrame) -> DataFrame:
    """Several one-row frames as one row, through one aggregate over their
    union (no join)."""
    cols = [c for o in ones for c in o.columns]
    u = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), ones)
    return u.agg(*[F.max(c).alias(c) for c in cols])


@query("signal_importance")
def q_signal_importance(spark, d):
    """Importance of raw + z + trend per signal from the final forest."""
    train, _ = train_test(spark, d)
    m = final_forest(train)
    imp =MD.signal_importance(m, COLS21, SIG)
    return spark.createDataFrame(sorted(imp.items()), "signal string, importance double")


@query("baselines")
def q_baselines(spark, d):
    """B1 rule, B2 logistic, B3 forest, B4 isolation forest, B5 boosting and the
    final forest with trend features: one row per model with AUROC and PR-AUC
    on the test entities (the model comparison table). All models are fitted on
    all train rows (B4's trees draw theirs from all, by its method)."""
    from vitalgrid.operators.isolation import fit_isolation_forest, score_isolation_forest
    train, test = train_test(spark, d)
    whole = training_rows(train, None)
    # six models read these rows, so the split runs once a side
    train = materialize(train.select("event_id", *COLS14, Y), "train")
    test = materialize(test.select(*COLS21, Y), "test")
    rows = []
    # B1 reads the z-scores of the feature table (statistics over all history)
    b1 = test.withColumn("risk_score", any_exceeds_expr([f"{s}_zscore" for s in SIG], 2.0).cast("double"))
    rows.append(MD.evaluate(b1, Y, "B1 threshold rule"))
    rows.append(MD.evaluate(MD.score(MD.fit_logistic(train, COLS14, Y), test, COLS14), Y, "B2 logistic"))
    rows.append(MD.evaluate(MD.score(MD.fit_forest(whole, COLS14, Y, 50, 12), test, COLS14), Y, "B3 forest"))
    iso = fit_isolation_forest(train, COLS14, key="event_id", n_trees=100, sample_size=256, seed=42)
    rows.append(MD.evaluate(score_isolation_forest(iso, test, COLS14, out="risk_score"), Y, "B4 isolation forest"))
    rows.append(MD.evaluate(MD.score(MD.fit_boosting(whole, COLS14, Y, 150), test, COLS14), Y, "B5 boosting"))
    fin = MD.score(MD.fit_forest(whole, COLS21, Y, num_trees=100, max_depth=14), test, COLS21)
    rows.append(MD.evaluate(fin, Y, "final forest + trend"))
    return rounded(reduce(DataFrame.unionByName, rows))


@query("ablation")
def q_ablation(spark, d):
    """Refit boosting without each signal and its z / trend columns: AUROC,
    drop against the full model, rank by drop (1 = most important) and flags
    for the most and least important signal."""
    train, test = train_test(spark, d)
    t = MD.ablation_boosting(training_rows(train), test, SIG, COLS14, Y, derived_columns, max_iter=150)
    return rounded(MD.rank_ablation(t))


def rule_score(zcols, rows: DataFrame, cols) -> DataFrame:
    """Risk of a rule without a fit: the largest |z| of its signals."""
    return rows.withColumn("risk_score", F.array_max(F.array(*[F.coalesce(F.abs(c), F.lit(0.0)) for c in zcols])))


@query("ablation_rule", flag_sql(2.0) + """,
f AS (SELECT coalesce(abs(value_zscore), 0) AS zv, coalesce(abs(k_zscore), 0) AS zk,
             CAST(max(CAST(risk_event_now AS INTEGER)) OVER (PARTITION BY user_id ORDER BY ts, event_id
                  ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING) AS INTEGER) AS label FROM flagged),
vb AS (SELECT greatest(zv, zk) AS score, label FROM f), vv AS (SELECT zk AS score, label FROM f),
vk AS (SELECT zv AS score, label FROM f),
b AS """ + auroc_sql("vb") + """,
t AS (SELECT 'value' AS signal, auroc FROM """ + auroc_sql("vv") + """
      UNION ALL SELECT 'k', auroc FROM """ + auroc_sql("vk") + """),
r AS (SELECT signal, t.auroc, b.auroc - t.auroc AS auroc_drop, b.auroc AS baseline_auroc,
             CAST(row_number() OVER (ORDER BY b.auroc - t.auroc DESC, signal) AS INTEGER) AS rank FROM t, b)
SELECT signal, round(auroc, 6) AS auroc, round(auroc_drop, 6) AS auroc_drop, round(baseline_auroc, 6) AS baseline_auroc,
       rank, rank = 1 AS most_important, rank = 2 AS least_important FROM r""")
def q_ablation_rule(spark, d):
    """The ablation ranking for a rule score (largest |z|) with one signal left out at a time."""
    feats = labelled(spark, d)
    t = MD.ablation(feats, feats, SIG, COLS14, Y, lambda _, cols, __: [c for c in cols if c.endswith("_zscore")],
                    derived_columns, apply=rule_score)
    return rounded(MD.rank_ablation(t))


@query("entity_folds", X.P_RAW_SQL + """
SELECT event_id, user_id, CAST(floor(('0x' || substr(md5(CAST(user_id AS VARCHAR) || ':fold:42'), 1, 8))::BIGINT
                                     / 4294967296.0 * 3) AS INTEGER) AS fold FROM p_raw""")
def q_entity_folds(spark, d):
    """Cross-validation folds that share no entity (``random_search(fold_by='entity')``)."""
    return X.p_raw(spark, d).select("event_id", E, MD.fold_id(E, SEARCH_FOLDS, 42).alias("fold"))


# Fixed value: training rows of the query below end before this time.
TRAIN_END = "2024-01-15"


@query("zscore_train_stats", X.P_RAW_SQL + f""",
s AS (SELECT user_id, avg(value) AS mv, stddev_samp(value) AS sv, avg(k) AS mk, stddev_samp(k) AS sk
      FROM p_raw WHERE ts < TIMESTAMP '{TRAIN_END}' GROUP BY user_id)
SELECT event_id, round((value - mv) / nullif(sv, 0), 6) AS value_zscore, round((k - mk) / nullif(sk, 0), 6) AS k_zscore
FROM p_raw LEFT JOIN s USING (user_id)""")
def q_zscore_train_stats(spark, d):
    """Z-scores whose statistics come from training rows alone (no leak of later rows)."""
    p = X.p_raw(spark, d)
    stats = entity_stats(p.filter(F.col("ts") < F.lit(TRAIN_END).cast("timestamp")), E, SIG)
    return rounded(zscore(p, E, SIG, stats=stats).select("event_id", "value_zscore", "k_zscore"))


@query("seed_robustness")
def q_seed_robustness(spark, d):
    """Boosting with seeds 42, 123, 2024: AUROC per seed, then mean and population std."""
    from vitalgrid.operators.metrics import seed_summary
    train, test = train_test(spark, d)
    runs = MD.seed_robustness(training_rows(train), test, COLS14, Y,
                              lambda tr, cols, y, seed: MD.fit_boosting(tr, cols, y, max_iter=150, seed=seed),
                              [42, 123, 2024])
    return rounded(seed_summary(runs.withColumn("setup", F.lit("boosting")), "setup", ["auroc", "prauc"]))


def _search(spark, d, kind: str):
    """The untuned forest and the tuned model side by side: parameters, CV AUROC
    (none for the untuned one), test AUROC and PR-AUC."""
    train, test = train_test(spark, d, sustained=True)
    sample = training_rows(train, SEARCH_ROWS)
    best, table = MD.random_search(sample, COLS14, Y, kind=kind, n_iter=SEARCH_DRAWS, folds=SEARCH_FOLDS, seed=42,
                                   key="event_id")
    won = table.first()
    untuned = MD.grow_forest(sample, COLS14, Y, num_trees=100, max_depth=14)
    rows = [MD.evaluate(MD.score(m, test, COLS14), Y, name).withColumns(
                {"cv_auroc": F.lit(cv).cast("double"), "params": F.lit(params)})
            for m, name, cv, params in [(untuned, "untuned rf", None, "{'n_estimators': 100, 'max_depth': 14}"),
                                        (best, f"tuned {kind}", won["cv_auroc"], won["params"])]]
    return rounded(reduce(DataFrame.unionByName, rows))


@query("random_search_rf")
def q_random_search_rf(spark, d):
    """Forest search over the reference space (15 draws x 3 row folds on a
    sample of the sustained label), beside the untuned forest."""
    return _search(spark, d, "rf")


@query("random_search_gb")
def q_random_search_gb(spark, d):
    """Boosting search over the reference space (15 draws x 3 row folds on a
    sample of the sustained label), beside the untuned forest."""
    return _search(spark, d, "gb")


@query("isolation_forest")
def q_isolation_forest(spark, d):
    """B4: isolation forest (100 trees of 256 rows) fitted on the train
    entities; anomaly score of every test row."""
    from vitalgrid.operators.isolation import fit_isolation_forest, score_isolation_forest
    train, test = train_test(spark, d)
    iso = fit_isolation_forest(train, COLS14, key="event_id", n_trees=100, sample_size=256, seed=42)
    return rounded(score_isolation_forest(iso, test, COLS14).select(E, "event_id", Y, "anomaly_score"))


@query("isolation_sample", X.P_RAW_SQL + """,
n AS (SELECT least(256, count(*)) AS m, least(1.0, 4.0 * least(256, count(*)) / greatest(count(*), 1)) AS rate FROM p_raw),
a AS (SELECT m, rate, least(1.0, 100 * rate) AS p_any FROM n),
c AS (SELECT event_id, tree, m, rate / p_any AS cond,
             ('0x' || substr(md5(event_id || ':' || tree || ':42'), 1, 8))::BIGINT / 4294967296.0 AS u
      FROM p_raw, a, (SELECT CAST(range AS INTEGER) AS tree FROM range(100))
      WHERE ('0x' || substr(md5(event_id || ':any:42'), 1, 8))::BIGINT / 4294967296.0 < p_any)
SELECT event_id, tree FROM (SELECT event_id, tree, m, row_number() OVER (PARTITION BY tree ORDER BY u, event_id) AS r
                            FROM c WHERE u < cond) WHERE r <= m""")
def q_isolation_sample(spark, d):
    """The rows on which each tree of the isolation forest is grown."""
    from vitalgrid.operators.isolation import tree_samples
    return tree_samples(X.p_raw(spark, d), SIG, "event_id", n_trees=100, sample_size=256, seed=42)[0].select(
        "event_id", "tree")


@query("serving_table")
def q_serving_table(spark, d):
    """The whole serving job on P-raw: final forest -> last 3 days of every
    entity -> risk, uncertainty, leading factors -> 1-day bins."""
    from vitalgrid.operators.serving import serving_table
    feats = labelled(spark, d)
    m = final_forest(split_by_entity(feats, E, 0.25, seed=42)[0])
    out = serving_table(feats, m, E, "ts", SIG, COLS21, days=3, bin_size="1 day",
                        names={"value": "Value", "k": "K"}, tie=["event_id"])
    return rounded(out)


# ------------------------------------------------------------------ a given ensemble
# An ensemble given by a rule (as one trained elsewhere would be given by its node table), so that SQL can walk the same
# trees: complete trees of depth 3 over the z-scores and trends (columns 2 .. 5), nodes k = 1 .. 15 as in a heap.
GIVEN_TREES = 12


def given_forest(spark):
    """The given ensemble as a Spark ML forest: t and k decide feature, threshold, gain, rows and leaf value."""
    rows = []
    for t in range(GIVEN_TREES):
        number = {}

        def walk(k: int) -> None:
            number[k] = len(number)
            if k < 8:
                walk(2 * k)
                walk(2 * k + 1)

        walk(1)
        for k, n in number.items():
            count = float(8 >> (k.bit_length() - 1))
            rows.append((t, n, 2 + (t + k) % 4, ((5 * t + 3 * k) % 13 - 6) / 5, number[2 * k], number[2 * k + 1], 0.5, count,
                         ((2 * t + k) % 7 + 1) / 10) if k < 8 else
                        (t, n, -1, -1.0, -1, -1, ((7 * t + 5 * k) % 17) / 16.7, count, -1.0))
    return ensemble(spark.createDataFrame(rows, NODES), "forest", len(COLS21), GIVEN_TREES)


def _step(k: str) -> str:
    return f"2 * {k} + CAST(x[1 + (t + {k}) % 4] > ((5 * t + 3 * {k}) % 13 - 6) / 5.0 AS INTEGER)"


GIVEN_SQL = flag_sql(2.0) + f""",
feats AS (SELECT user_id, ts, event_id, coalesce(value, value_mean) AS value, coalesce(k, k_mean) AS k,
                 value_zscore, k_zscore, avg(value_zscore) OVER w AS value_zscore_trend, avg(k_zscore) OVER w AS k_zscore_trend
          FROM flagged LEFT JOIN st USING (user_id)
          WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)),
walk AS (SELECT user_id, event_id, t, {_step("k2")} AS leaf FROM (
           SELECT *, {_step("k1")} AS k2 FROM (
             SELECT *, {_step("1")} AS k1 FROM (
               SELECT user_id, event_id, [coalesce(value_zscore, 0), coalesce(k_zscore, 0), coalesce(value_zscore_trend, 0),
                                          coalesce(k_zscore_trend, 0)] AS x FROM feats), range({GIVEN_TREES}) r(t)))),
scored AS (SELECT user_id, event_id, avg(p) AS risk_score, sqrt(greatest(avg(p * p) - avg(p) * avg(p), 0)) AS uncertainty
           FROM (SELECT user_id, event_id, ((7 * t + 5 * leaf) % 17) / 16.7::DOUBLE AS p FROM walk) GROUP BY user_id, event_id),
nodes AS (SELECT t, 2 + (t + k) % 4 AS feature, ((2 * t + k) % 7 + 1) / 10.0 * (8 >> CAST(floor(log2(k)) AS INTEGER)) AS gain
          FROM range({GIVEN_TREES}) a(t), range(1, 8) b(k)),
importance AS (SELECT CASE WHEN feature % 2 = 0 THEN 'value' ELSE 'k' END AS signal, sum(share) / {GIVEN_TREES} AS importance
               FROM (SELECT feature, gain / sum(gain) OVER (PARTITION BY t) AS share FROM nodes) GROUP BY 1)"""


@query("tree_uncertainty_given", GIVEN_SQL + """
SELECT user_id, event_id, round(risk_score, 6) AS risk_score, round(uncertainty, 6) AS uncertainty FROM scored""")
def q_tree_uncertainty_given(spark, d):
    """Risk and per-tree spread of every row by a given ensemble of trees."""
    s = MD.tree_uncertainty(given_forest(spark), labelled(spark, d), COLS21)
    return rounded(s.select(E, "event_id", "risk_score", "uncertainty"))


@query("signal_importance_given", GIVEN_SQL + """
SELECT signal, round(importance, 6) AS importance FROM importance""")
def q_signal_importance_given(spark, d):
    """Importance of raw + z + trend per signal of a given ensemble, for the signals that have rows."""
    imp = MD.signal_importance(given_forest(spark), COLS21, SIG)
    here = X.p_raw(spark, d).agg(*[F.count(s).alias(s) for s in SIG])
    told = here.select(F.inline(F.array(*[F.struct(F.lit(s).alias("signal"), F.lit(imp[s]).alias("importance"),
                                                   F.col(s).alias("n")) for s in SIG])))
    return rounded(told.filter("n > 0").select("signal", "importance"))


@query("serving_table_given", GIVEN_SQL + """,
recent AS (SELECT f.* FROM feats f JOIN (SELECT user_id, max(ts) AS tmax FROM feats GROUP BY user_id) USING (user_id)
           WHERE ts >= tmax - INTERVAL 3 DAY),
ranked AS (SELECT r.*, risk_score, uncertainty, coalesce(abs(value_zscore) * v.importance, -1) AS cv,
                  coalesce(abs(k_zscore) * i.importance, -1) AS ck
           FROM recent r JOIN scored USING (user_id, event_id), (SELECT importance FROM importance WHERE signal = 'value') v,
                (SELECT importance FROM importance WHERE signal = 'k') i),
named AS (SELECT *, CASE WHEN ck > cv THEN 'K' ELSE 'Value' END AS f1, CASE WHEN ck > cv THEN 'Value' ELSE 'K' END AS f2
          FROM ranked),
binned AS (SELECT user_id, date_trunc('day', ts) AS ts, avg(value) AS value, avg(k) AS k, avg(risk_score) AS risk_score,
                  avg(uncertainty) AS uncertainty, arg_max(f1, (ts, event_id)) AS top_factor_1,
                  arg_max(f2, (ts, event_id)) AS top_factor_2 FROM named GROUP BY 1, 2)
SELECT user_id, ts, round(value, 6) AS value, round(k, 6) AS k, round(risk_score, 6) AS risk_score,
       round(uncertainty, 6) AS uncertainty, top_factor_1, top_factor_2
FROM binned WHERE value IS NOT NULL AND k IS NOT NULL""")
def q_serving_table_given(spark, d):
    """The whole serving job with a given ensemble: last 3 days of every entity -> risk, uncertainty, leading
    factors -> 1-day bins."""
    from vitalgrid.operators.serving import serving_table
    out = serving_table(labelled(spark, d), given_forest(spark), E, "ts", SIG, COLS21, days=3, bin_size="1 day",
                        names={"value": "Value", "k": "K"}, tie=["event_id"])
    return rounded(out)


@query("survey_models")
def q_survey_models(spark, d):
    """Questionnaire workflow on Q-form: answers coerced to numbers, incomplete
    rows dropped, Likert total, target = total above its exact median,
    stratified 75/25 split, logistic regression and a 100-tree forest on the
    binary answers; accuracy and AUROC per model, then the class report of each."""
    from vitalgrid.operators import filters as FL
    from vitalgrid.operators import metrics as ME
    from vitalgrid.operators.aggregates import median_split
    from vitalgrid.operators.splits import split_stratified
    f = FL.coerce_numeric(X.q_form(spark, d), X.Q_SYMPTOMS + X.Q_LIKERT)
    f = FL.drop_incomplete(f, X.Q_SYMPTOMS + X.Q_LIKERT)
    f = median_split(FL.row_sum(f, X.Q_LIKERT, "total_score"), "total_score", out="target")
    f = materialize(f, "survey")
    train, test = split_stratified(f, "target", "resp_id", 0.25, seed=42)
    out = []
    for name, model in [("logistic", MD.fit_logistic(train, X.Q_SYMPTOMS, "target", balanced=False)),
                        ("forest", MD.fit_forest(train, X.Q_SYMPTOMS, "target", num_trees=100, max_depth=30,
                                                 balanced=False))]:
        s = MD.score(model, test, X.Q_SYMPTOMS).withColumn("pred", (F.col("risk_score") >= 0.5).cast("int"))
        acc = ME.accuracy(s, "pred", "target")
        auc = ME.auroc(s, "risk_score", "target")
        rep = ME.class_report(s, "pred", "target")
        summary = side_by_side(acc, auc)
        out.append(rep.withColumn("model", F.lit(name)).unionByName(
            summary.withColumn("model", F.lit(name)), allowMissingColumns=True))
    return rounded(reduce(DataFrame.unionByName, out))
