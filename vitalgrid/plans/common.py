"""SQL pieces shared by several query modules (oracle side)."""

from __future__ import annotations

from vitalgrid.sources import fixtures as X

# ------------------------------------------------------------------ SQL pieces
STATS_SQL = X.P_RAW_SQL + """,
st AS (SELECT user_id, avg(value) AS value_mean, stddev_samp(value) AS value_std,
              avg(k) AS k_mean, stddev_samp(k) AS k_std FROM p_raw GROUP BY user_id)"""
Z_SQL = STATS_SQL + """,
z AS (SELECT p.*, (value - value_mean) / nullif(value_std, 0) AS value_zscore,
             (k - k_mean) / nullif(k_std, 0) AS k_zscore
      FROM p_raw p LEFT JOIN st USING (user_id))"""


def flag_sql(thr: float, name: str = "flagged") -> str:
    return Z_SQL + f""",
{name} AS (SELECT *, coalesce(abs(value_zscore) > {thr}, false) OR coalesce(abs(k_zscore) > {thr}, false)
              AS risk_event_now FROM z)"""


def auroc_sql(src: str, by: str = "") -> str:
    """Exact AUROC in plain SQL over ``src(score, label[, by])`` (oracle side)."""
    part = f"PARTITION BY {by} " if by else ""
    sel = f"{by}, " if by else ""
    grp = f"GROUP BY {by}" if by else ""
    return f"""(SELECT {sel}sum(pos * (below + 0.5 * neg)) / (sum(pos) * sum(neg)) AS auroc FROM (
      SELECT *, sum(neg) OVER ({part}ORDER BY score ROWS UNBOUNDED PRECEDING) - neg AS below FROM (
        SELECT {sel}score, sum(label) AS pos, sum(1 - label) AS neg FROM {src}
        WHERE score IS NOT NULL GROUP BY {sel}score)) {grp})"""
