"""Metrics, splits and sampling queries with their oracles (Y-event, Q-form)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalgrid.operators import filters as FL
from vitalgrid.operators import metrics as M
from vitalgrid.operators import splits as SP
from vitalgrid.operators.aggregates import median_split
from vitalgrid.plans.common import auroc_sql
from vitalgrid.plans.registry import query, rounded
from vitalgrid.session import materialize
from vitalgrid.sources import fixtures as X

E = "user_id"
SEEDS = [1, 2, 3, 4, 5]


def _ap_sql(src: str, by: str = "") -> str:
    part = f"PARTITION BY {by} " if by else ""
    sel = f"{by}, " if by else ""
    grp = f"GROUP BY {by}" if by else ""
    return f"""(SELECT {sel}sum(pos * tp / (tp + fp)) / sum(pos) AS prauc FROM (
      SELECT *, sum(pos) OVER ({part}ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS tp,
                sum(neg) OVER ({part}ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS fp FROM (
        SELECT {sel}score, sum(label) AS pos, sum(1 - label) AS neg FROM {src}
        WHERE score IS NOT NULL GROUP BY {sel}score)) {grp})"""


# ------------------------------------------------------------------ metrics
@query("auroc", X.Y_EVENT_SQL + "\nSELECT round(auroc, 6) AS auroc FROM " + auroc_sql("y_event"))
def q_auroc(spark, d):
    return rounded(M.auroc(X.y_event(spark, d), "score", "label"))


@query("average_precision", X.Y_EVENT_SQL + "\nSELECT round(prauc, 6) AS average_precision FROM "
       + _ap_sql("y_event"))
def q_average_precision(spark, d):
    return rounded(M.average_precision(X.y_event(spark, d), "score", "label"))


@query("brier", X.Y_EVENT_SQL + """
SELECT round(avg(power(score / (score + 50.0) - label, 2)), 6) AS brier FROM y_event""")
def q_brier(spark, d):
    y = X.y_event(spark, d).withColumn("prob", F.col("score") / (F.col("score") + F.lit(50.0)))
    return rounded(M.brier(y, "prob", "label"))


@query("uncertainty_summary_serving", X.P_SERVE_SQL + """
SELECT round(avg(uncertainty), 6) AS mean_uncertainty, round(min(uncertainty), 6) AS min_uncertainty,
       round(max(uncertainty), 6) AS max_uncertainty FROM p_serve""")
def q_uncertainty_summary_serving(spark, d):
    return rounded(M.uncertainty_summary(X.p_serve(spark, d)))


@query("accuracy", X.Y_EVENT_SQL + """
SELECT round(avg(CASE WHEN CAST(score > 90 AS INTEGER) = label THEN 1.0 ELSE 0.0 END), 6) AS accuracy
FROM y_event""")
def q_accuracy(spark, d):
    y = X.y_event(spark, d).withColumn("pred", (F.col("score") > 90).cast("int"))
    return rounded(M.accuracy(y, "pred", "label"))


@query("class_report", X.Y_EVENT_SQL + """,
yp AS (SELECT label AS y, CAST(score > 90 AS INTEGER) AS p FROM y_event),
cls AS (SELECT y AS c FROM yp UNION SELECT p FROM yp),
per AS (SELECT c, (SELECT count(*) FROM yp WHERE y = c AND p = c) AS tp,
               (SELECT count(*) FROM yp WHERE y = c) AS support, (SELECT count(*) FROM yp WHERE p = c) AS npred
        FROM cls),
pr AS (SELECT c, support, tp, CASE WHEN npred = 0 THEN 0.0 ELSE tp / npred END AS precision,
              CASE WHEN support = 0 THEN 0.0 ELSE tp / support END AS recall FROM per),
f AS (SELECT *, CASE WHEN precision + recall = 0 THEN 0.0 ELSE 2 * precision * recall / (precision + recall) END
                AS f1_score FROM pr)
SELECT CAST(c AS VARCHAR) AS class, round(precision, 6) AS precision, round(recall, 6) AS recall,
       round(f1_score, 6) AS f1_score, support FROM f
UNION ALL SELECT 'accuracy', NULL, NULL, round(sum(tp) / sum(support), 6), sum(support) FROM f
UNION ALL SELECT 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1_score), 6),
                 sum(support) FROM f
UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 6),
                 round(sum(recall * support) / sum(support), 6), round(sum(f1_score * support) / sum(support), 6),
                 sum(support) FROM f""")
def q_class_report(spark, d):
    y = X.y_event(spark, d).withColumn("pred", (F.col("score") > 90).cast("int"))
    return rounded(M.class_report(y, "pred", "label"))


LONG_SQL = X.Y_EVENT_SQL + """,
lng AS (SELECT 'value' AS model, event_id, score, label FROM y_event
        UNION ALL SELECT 'k', event_id, k, label FROM y_event
        UNION ALL SELECT 'rule', event_id, CAST(score > 90 AS DOUBLE), label FROM y_event)"""


def long_predictions(spark, d) -> DataFrame:
    """Per-model prediction rows stacked into one long table (unionByName)."""
    y = X.y_event(spark, d)
    parts = [y.select(F.lit("value").alias("model"), "event_id", "score", "label"),
             y.select(F.lit("k").alias("model"), "event_id", F.col("k").alias("score"), "label"),
             y.select(F.lit("rule").alias("model"), "event_id",
                      (F.col("score") > 90).cast("double").alias("score"), "label")]
    return reduce(DataFrame.unionByName, parts)


@query("union_results", LONG_SQL + "\nSELECT model, event_id, round(score, 6) AS score, label FROM lng")
def q_union_results(spark, d):
    return rounded(long_predictions(spark, d))


@query("model_table", LONG_SQL + """
SELECT a.model, round(a.auroc, 6) AS auroc, round(p.prauc, 6) AS prauc
FROM """ + auroc_sql("lng", "model") + " a JOIN " + _ap_sql("lng", "model") + " p USING (model)")
def q_model_table(spark, d):
    return rounded(M.model_table(long_predictions(spark, d), "model", "score", "label"))


# ------------------------------------------------------------------ splits and samples
RANK_SQL = X.P_RAW_SQL + """,
ents AS (SELECT DISTINCT user_id FROM p_raw),
rk AS (SELECT user_id, row_number() OVER (ORDER BY md5(CAST(user_id AS VARCHAR) || ':42'), user_id) AS r,
              count(*) OVER () AS n FROM ents)"""


@query("split_by_entity", RANK_SQL + """
SELECT user_id, r <= ceil(0.25 * n) AS is_test FROM rk""")
def q_split_by_entity(spark, d):
    r = X.p_raw(spark, d)
    train, test = SP.split_by_entity(r, E, 0.25, seed=42)
    return (train.select(E).distinct().withColumn("is_test", F.lit(False))
            .unionByName(test.select(E).distinct().withColumn("is_test", F.lit(True))))


@query("split_stratified", X.Y_EVENT_SQL + """,
r AS (SELECT event_id, label, row_number() OVER (PARTITION BY label
          ORDER BY md5(CAST(event_id AS VARCHAR) || ':42'), event_id) AS rn,
         count(*) OVER (PARTITION BY label) AS ny FROM y_event)
SELECT event_id, label, rn <= round(0.25 * ny) AS is_test FROM r""")
def q_split_stratified(spark, d):
    y = X.y_event(spark, d).select("event_id", "label")
    train, test = SP.split_stratified(y, "label", "event_id", 0.25, seed=42)
    return (train.withColumn("is_test", F.lit(False)).unionByName(test.withColumn("is_test", F.lit(True))))


@query("assign_clients", RANK_SQL.replace(":42'", ":7'") + """,
q AS (SELECT *, n // 4 AS qq, n - (n // 4) * 4 AS rem FROM rk)
SELECT user_id, CAST(CASE WHEN r - 1 < (qq + 1) * rem THEN (r - 1) // (qq + 1)
                          ELSE rem + (r - 1 - (qq + 1) * rem) // greatest(qq, 1) END AS INTEGER) AS client FROM q""")
def q_assign_clients(spark, d):
    return SP.assign_clients(X.p_raw(spark, d), E, k=4, seed=7)


@query("mask_cells", X.Y_EVENT_SQL + """
SELECT event_id,
  CASE WHEN ('0x' || substr(md5(CAST(event_id AS VARCHAR) || ':score:3'), 1, 8))::BIGINT / 4294967296.0 < 0.2
       THEN 0.0 ELSE round(score, 6) END AS score,
  CASE WHEN ('0x' || substr(md5(CAST(event_id AS VARCHAR) || ':k:3'), 1, 8))::BIGINT / 4294967296.0 < 0.2
       THEN 0.0 ELSE round(k, 6) END AS k
FROM y_event""")
def q_mask_cells(spark, d):
    y = X.y_event(spark, d).select("event_id", "score", "k")
    return rounded(SP.mask_cells(y, ["score", "k"], 0.2, seed=3, key="event_id"))


@query("class_weights", X.Y_EVENT_SQL + """,
c AS (SELECT label, count(*) AS ny FROM y_event GROUP BY label)
SELECT event_id, label, round((SELECT count(*) FROM y_event) / ((SELECT count(*) FROM c) * ny), 6) AS weight
FROM y_event JOIN c USING (label)""")
def q_class_weights(spark, d):
    return rounded(SP.class_weights(X.y_event(spark, d), "label").select("event_id", "label", "weight"))


@query("standardise", RANK_SQL + """,
side AS (SELECT p.*, rk.r <= ceil(0.25 * rk.n) AS is_test FROM p_raw p JOIN rk USING (user_id)),
st AS (SELECT avg(value) AS mv, stddev_pop(value) AS sv, avg(k) AS mk, stddev_pop(k) AS sk FROM side
       WHERE NOT is_test)
SELECT event_id, is_test, round((value - mv) / coalesce(nullif(sv, 0), 1), 6) AS value,
       round((k - mk) / coalesce(nullif(sk, 0), 1), 6) AS k FROM side, st""")
def q_standardise(spark, d):
    r = X.p_raw(spark, d).select(E, "event_id", "value", "k")
    train, test = SP.split_by_entity(r, E, 0.25, seed=42)
    tr, te = SP.standardise(train, test, ["value", "k"])
    return rounded(tr.withColumn("is_test", F.lit(False)).unionByName(te.withColumn("is_test", F.lit(True)))
                   .select("event_id", "is_test", "value", "k"))


@query("threshold_rule", X.P_RAW_SQL + """,
st AS (SELECT user_id, avg(value) AS m, stddev_samp(value) AS s, avg(k) AS mk, stddev_samp(k) AS sk
       FROM p_raw GROUP BY user_id)
SELECT event_id, CAST(coalesce(abs((value - m) / nullif(s, 0)) > 2, false)
                      OR coalesce(abs((k - mk) / nullif(sk, 0)) > 2, false) AS INTEGER) AS pred
FROM p_raw JOIN st USING (user_id)""")
def q_threshold_rule(spark, d):
    from vitalgrid.operators.models import threshold_rule
    return threshold_rule(X.p_raw(spark, d), E, X.P_RAW_SIGNALS, 2.0).select("event_id", "pred")


@query("seed_summary", X.Y_EVENT_SQL + """,
seeds AS (SELECT range AS seed FROM range(1, 6)),
ents AS (SELECT DISTINCT user_id FROM y_event),
rk AS (SELECT s.seed, e.user_id, row_number() OVER (PARTITION BY s.seed
          ORDER BY md5(CAST(e.user_id AS VARCHAR) || ':' || CAST(s.seed AS VARCHAR)), e.user_id) AS r,
          count(*) OVER (PARTITION BY s.seed) AS n FROM seeds s, ents e),
te AS (SELECT seed, user_id FROM rk WHERE r <= ceil(0.25 * n)),
rows AS (SELECT te.seed, y.score, y.label FROM y_event y JOIN te USING (user_id)),
res AS """ + auroc_sql("rows", "seed") + """
SELECT 'value' AS setup, count(*) AS n_runs, round(avg(auroc), 6) AS auroc_mean,
       round(stddev_pop(auroc), 6) AS auroc_std FROM res""")
def q_seed_summary(spark, d):
    """Test-split AUROC of the ``value`` score for five seeds of the entity
    split, then mean and population std over the seeds."""
    y = X.y_event(spark, d)
    ids = materialize(y.select(E).distinct(), "entities")  # one row per entity; every seed ranks these
    tests = reduce(DataFrame.unionByName, [SP.test_entities(ids, E, 0.25, seed=s).withColumn("seed", F.lit(s)) for s in SEEDS])
    results = M.auroc(y.join(tests, E), "score", "label", by="seed").withColumn("setup", F.lit("value"))
    return rounded(M.seed_summary(results, "setup", ["auroc"]))


@query("median_split", X.Q_FORM_SQL + """,
c AS (SELECT resp_id, TRY_CAST(lik_1 AS DOUBLE) AS l1, TRY_CAST(lik_2 AS DOUBLE) AS l2,
             TRY_CAST(lik_3 AS DOUBLE) AS l3 FROM q_form),
t AS (SELECT resp_id, l1 + l2 + l3 AS total FROM c WHERE l1 IS NOT NULL AND l2 IS NOT NULL AND l3 IS NOT NULL)
SELECT resp_id, total, CAST(total > (SELECT median(total) FROM t) AS INTEGER) AS target FROM t""")
def q_median_split(spark, d):
    f = FL.drop_incomplete(FL.coerce_numeric(X.q_form(spark, d), X.Q_LIKERT), X.Q_LIKERT)
    f = FL.row_sum(f, X.Q_LIKERT, "total")
    return median_split(f, "total", out="target").select("resp_id", "total", "target")
