"""Adapters from the driver's test tables to panel inputs (see FIXTURES.md §3).

Each adapter exists twice: as a Spark DataFrame builder and as a DuckDB CTE with
the same columns, so every oracle query can start from the same input. The
adapters only reshape rows into the schema an operator expects; the operators
do all of the work.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitalgrid.functions.scalar import nan_to_null
from vitalgrid.session import pin_utc

# Fixed value: the text planted as an unreadable answer in the Q-form adapter.
BAD_TEXT = "n/a"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    pin_utc(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------- P-raw
def p_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events -> panel: entity ``user_id``, time ``ts`` (tie ``event_id``),
    signals ``value`` and ``k`` (= props.$.k)."""
    ev = table(spark, sf_dir, "events")
    return ev.select(
        F.col("user_id").cast("long").alias("user_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_id").cast("long").alias("event_id"),
        F.col("event_type"),
        nan_to_null("value").alias("value"),
        nan_to_null(F.get_json_object("props", "$.k").try_cast("double")).alias("k"),
    )


P_RAW_SQL = """p_raw AS (
  SELECT CAST(user_id AS BIGINT) AS user_id, CAST(ts AS TIMESTAMP) AS ts,
         CAST(event_id AS BIGINT) AS event_id, event_type, value,
         TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k
  FROM events)"""

P_RAW_SIGNALS = ["value", "k"]


# ---------------------------------------------------------------- P-day
def p_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P-raw averaged per user and calendar day: a regular 1-day grid with gaps."""
    r = p_raw(spark, sf_dir)
    return (r.groupBy("user_id", F.date_trunc("day", "ts").alias("ts"))
             .agg(F.avg("value").alias("value"), F.avg("k").alias("k")))


P_DAY_SQL = P_RAW_SQL + """,
p_day AS (
  SELECT user_id, date_trunc('day', ts) AS ts, avg(value) AS value, avg(k) AS k
  FROM p_raw GROUP BY 1, 2)"""


# ---------------------------------------------------------------- P-type
EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]


def p_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per user and day, the mean value of each event type: five signals with many NULLs."""
    r = p_raw(spark, sf_dir)
    return (r.groupBy("user_id", F.date_trunc("day", "ts").alias("ts"))
             .agg(*[F.avg(F.when(F.col("event_type") == t, F.col("value"))).alias(t) for t in EVENT_TYPES]))


P_TYPE_SQL = P_RAW_SQL + """,
p_type AS (
  SELECT user_id, date_trunc('day', ts) AS ts,
""" + ",\n".join(f"         avg(CASE WHEN event_type = '{t}' THEN value END) AS {t}" for t in EVENT_TYPES) + """
  FROM p_raw GROUP BY 1, 2)"""


# ---------------------------------------------------------------- P-serve
def p_serve(spark: SparkSession, sf_dir: str, with_type: bool = False) -> DataFrame:
    """P-raw shaped like a serving table: ``risk_score`` and ``uncertainty`` in [0, 1)
    derived from the two signals (``with_type``: keep ``event_type`` as a text column)."""
    r = p_raw(spark, sf_dir)
    return r.select("user_id", F.col("ts").alias("received_date"), *(["event_type"] if with_type else []),
                    "event_id", "value", "k",
                    (F.col("value") / (F.col("value") + F.lit(50.0))).alias("risk_score"),
                    (F.col("k") / (F.col("k") + F.lit(100.0))).alias("uncertainty"))


P_SERVE_SQL = P_RAW_SQL + """,
p_serve AS (
  SELECT user_id, ts AS received_date, event_id, value, k,
         value / (value + 50.0) AS risk_score, k / (k + 100.0) AS uncertainty
  FROM p_raw)"""


# ---------------------------------------------------------------- P-ship
def p_ship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem -> panel: entity ``l_suppkey``, time ``l_shipdate``
    (ties ``l_orderkey, l_linenumber``), signals ``l_quantity, l_extendedprice``."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_suppkey").alias("supp"), F.col("l_shipdate").cast("timestamp").alias("ts"),
                     "l_orderkey", "l_linenumber",
                     nan_to_null("l_quantity").alias("qty"), nan_to_null("l_extendedprice").alias("price"))


P_SHIP_SQL = """p_ship AS (
  SELECT l_suppkey AS supp, CAST(l_shipdate AS TIMESTAMP) AS ts, l_orderkey, l_linenumber,
         l_quantity AS qty, l_extendedprice AS price
  FROM lineitem)"""


# ---------------------------------------------------------------- Y-event
def y_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored, labelled rows: ``score = value``, ``label = (event_type = 'error')``."""
    r = p_raw(spark, sf_dir)
    return r.select("user_id", "event_id", "ts", "event_type", F.col("value").alias("score"),
                    (F.col("event_type") == "error").cast("int").alias("label"), "k")


Y_EVENT_SQL = P_RAW_SQL + """,
y_event AS (
  SELECT user_id, event_id, ts, event_type, value AS score,
         CAST(event_type = 'error' AS INTEGER) AS label, k
  FROM p_raw)"""


# ---------------------------------------------------------------- Q-form
def q_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer -> questionnaire rows with answers as text and planted bad cells:
    three binary answers ``sym_*`` and three 0-4 answers ``lik_*``."""
    c = table(spark, sf_dir, "customer")
    key = F.col("c_custkey")
    return c.select(
        key.alias("resp_id"),
        (F.col("c_nationkey") % 2).cast("string").alias("sym_1"),
        F.when(F.col("c_acctbal") >= 0, 1).otherwise(0).cast("string").alias("sym_2"),
        (F.length("c_name") % 2).cast("string").alias("sym_3"),
        F.when(key % 7 == 0, F.lit(BAD_TEXT)).otherwise((F.col("c_nationkey") % 5).cast("string")).alias("lik_1"),
        (F.floor(F.abs(F.col("c_acctbal"))).cast("long") % 5).cast("string").alias("lik_2"),
        F.when(key % 7 == 3, F.lit("")).otherwise(((key * 3 + F.col("c_nationkey")) % 5).cast("string"))
         .alias("lik_3"),
    )


Q_FORM_SQL = """q_form AS (
  SELECT c_custkey AS resp_id,
         CAST(c_nationkey % 2 AS VARCHAR) AS sym_1,
         CAST(CASE WHEN c_acctbal >= 0 THEN 1 ELSE 0 END AS VARCHAR) AS sym_2,
         CAST(length(c_name) % 2 AS VARCHAR) AS sym_3,
         CASE WHEN c_custkey % 7 = 0 THEN 'n/a' ELSE CAST(c_nationkey % 5 AS VARCHAR) END AS lik_1,
         CAST(CAST(floor(abs(c_acctbal)) AS BIGINT) % 5 AS VARCHAR) AS lik_2,
         CASE WHEN c_custkey % 7 = 3 THEN '' ELSE CAST((c_custkey * 3 + c_nationkey) % 5 AS VARCHAR) END AS lik_3
  FROM customer)"""

Q_SYMPTOMS = ["sym_1", "sym_2", "sym_3"]
Q_LIKERT = ["lik_1", "lik_2", "lik_3"]


# ---------------------------------------------------------------- Y-vec
def y_vec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings: ``vec_id``, ``embedding`` array<double>, ``label``."""
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("embedding"), "label")


Y_VEC_SQL = """y_vec AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS embedding, label FROM embeddings)"""


def with_ctes(*ctes: str) -> str:
    """Join CTE bodies into one ``WITH`` prefix, dropping repeated ones."""
    parts: list[str] = []
    for c in ctes:
        for piece in _split_ctes(c):
            if piece not in parts:
                parts.append(piece)
    return "WITH " + ",\n".join(parts) + "\n"


def _split_ctes(text: str) -> list[str]:
    out, depth, cur = [], 0, []
    for ch in text:
        if ch == "(":
            depth += 1
        elif ch == ")":
            depth -= 1
        if ch == "," and depth == 0:
            out.append("".join(cur).strip())
            cur = []
        else:
            cur.append(ch)
    if "".join(cur).strip():
        out.append("".join(cur).strip())
    return out
