"""Churn-shaped inputs derived from the driver tables.

The analysis needs a customer table with a status, a churn reason, tenure,
charges, a contract, a payment method, a zip key with a population lookup
and Yes/No service columns.  ``snap`` derives one such row per order from
orders, customer, supplier, lineitem and part (definition in FIXTURES.md
section 4); it only shapes rows, the analysis itself runs in ``operators``.
Each builder has an SQL twin so the DuckDB oracle sees the same input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attrition.functions.exprs import hex_digits_value, md5_key, yes_no
from attrition.operators.ordering import bucketed_running
from attrition.sources.tables import table

# Part types that play the service columns, in this order.
SERVICE_TYPES = ("STANDARD", "ECONOMY", "SMALL", "MEDIUM", "LARGE", "PROMO")
SERVICE_COLS = tuple(f"has_{t.lower()}" for t in SERVICE_TYPES)
# Order status -> contract label.
CONTRACT_OF_STATUS = {"F": "Month-to-Month", "O": "One Year", "P": "Two Year"}

SNAP_COLUMNS = ("id", "tenure", "charge", "total_charges", "status", "churn_category",
                "contract", "payment", "zip_code", "population", "n_lines", "qty", "disc",
                *SERVICE_COLS, "age")

# Customers with more orders than this get their running windows split by day.
HOT_CUSTOMER_ROWS = 100_000


def snap(spark: SparkSession, sf_dir: str, hot_customer_rows: int = HOT_CUSTOMER_ROWS) -> DataFrame:
    """One churn-snapshot row per order (see module doc)."""
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate",
        "o_orderpriority").withColumn("o_date", F.to_date("o_orderdate"))
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    suppliers = (table(spark, sf_dir, "supplier").groupBy("s_nationkey")
                 .agg(F.count(F.lit(1)).alias("population")))
    lines = (table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity", "l_discount")
             .join(table(spark, sf_dir, "part").select("p_partkey", "p_type"),
                   F.col("l_partkey") == F.col("p_partkey"), "left")
             .groupBy("l_orderkey")
             .agg(F.count(F.lit(1)).alias("n_lines"),
                  F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double").alias("qty"),
                  F.sum(F.col("l_discount").cast("decimal(18,2)")).cast("double").alias("disc"),
                  *[F.max(F.when(F.col("p_type") == t, 1).otherwise(0)).alias(f"_t_{t}")
                    for t in SERVICE_TYPES]))

    # Per-customer first date and size: a partial aggregation, skew-safe.
    per_cust = (orders.groupBy("o_custkey")
                .agg(F.min("o_date").alias("first_date"), F.count(F.lit(1)).alias("_n_orders"))
                .join(customer, F.col("o_custkey") == F.col("c_custkey"), "inner")
                .drop("c_custkey"))
    last_date = orders.agg(F.max("o_date")).scalar()

    base = orders.join(per_cust, "o_custkey", "inner")
    # Hot customers are split by day; everyone else keeps one window partition.
    day = F.datediff(F.col("o_date"), F.lit("1970-01-01").cast("date"))
    bucket = F.when(F.col("_n_orders") > F.lit(hot_customer_rows), day).otherwise(F.lit(0))
    base = bucketed_running(
        base, ["o_custkey"], bucket, ["o_orderdate", "o_orderkey"],
        sums={"_run_charge": F.col("o_totalprice").cast("decimal(18,2)")},
        nexts={"_next_date": F.col("o_date")})

    status = (F.when(F.col("_next_date").isNotNull()
                     & (F.datediff("_next_date", "o_date") <= 365), F.lit("Stayed"))
              .when(F.datediff(last_date, F.col("o_date")) <= 365, F.lit("Joined"))
              .otherwise(F.lit("Churned")))
    contract = None
    for k, v in CONTRACT_OF_STATUS.items():
        cond = F.col("o_orderstatus") == k
        contract = F.when(cond, F.lit(v)) if contract is None else contract.when(cond, F.lit(v))

    out = (base.join(suppliers, F.col("c_nationkey") == F.col("s_nationkey"), "left")
           .join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
           .withColumn("status", status))
    return out.select(
        F.col("o_orderkey").alias("id"),
        F.expr("datediff(o_date, first_date) div 30").cast("bigint").alias("tenure"),
        F.col("o_totalprice").alias("charge"),
        F.col("_run_charge").cast("double").alias("total_charges"),
        F.col("status"),
        F.when(F.col("status") == "Churned", F.col("o_orderpriority")).alias("churn_category"),
        contract.alias("contract"),
        F.col("c_mktsegment").alias("payment"),
        F.col("c_nationkey").alias("zip_code"),
        F.col("population"),
        F.col("n_lines"), F.col("qty"), F.col("disc"),
        *[yes_no(F.col(f"_t_{t}") == 1).alias(c) for t, c in zip(SERVICE_TYPES, SERVICE_COLS)],
        (F.lit(18) + F.col("o_custkey") % 60).cast("int").alias("age"),
    )


_SERVICE_SQL_MAX = ",\n    ".join(
    f"max(CASE WHEN p_type = '{t}' THEN 1 ELSE 0 END) AS t_{t.lower()}" for t in SERVICE_TYPES)
_SERVICE_SQL_OUT = ",\n  ".join(
    f"CASE l.t_{t.lower()} WHEN 1 THEN 'Yes' WHEN 0 THEN 'No' END AS {c}"
    for t, c in zip(SERVICE_TYPES, SERVICE_COLS))
_CONTRACT_SQL = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in CONTRACT_OF_STATUS.items())

SNAP_SQL = f"""
snap_cust AS (
  SELECT o_custkey AS cust, min(CAST(o_orderdate AS DATE)) AS first_date FROM orders GROUP BY o_custkey),
snap_last AS (SELECT max(CAST(o_orderdate AS DATE)) AS last_date FROM orders),
snap_sup AS (SELECT s_nationkey, count(*) AS population FROM supplier GROUP BY s_nationkey),
snap_lines AS (
  SELECT l_orderkey, count(*) AS n_lines,
    CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS qty,
    CAST(sum(CAST(l_discount AS DECIMAL(18,2))) AS DOUBLE) AS disc,
    {_SERVICE_SQL_MAX}
  FROM lineitem LEFT JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey),
snap_ord AS (
  SELECT o.*, CAST(o_orderdate AS DATE) AS o_date,
    lead(CAST(o_orderdate AS DATE)) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS next_date,
    CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey
         ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE) AS total_charges
  FROM orders o),
snap_st AS (
  SELECT o.*, CASE
      WHEN next_date IS NOT NULL AND date_diff('day', o_date, next_date) <= 365 THEN 'Stayed'
      WHEN date_diff('day', o_date, (SELECT last_date FROM snap_last)) <= 365 THEN 'Joined'
      ELSE 'Churned' END AS status
  FROM snap_ord o),
snap AS (
SELECT o.o_orderkey AS id,
  CAST(date_diff('day', cs.first_date, o.o_date) // 30 AS BIGINT) AS tenure,
  o.o_totalprice AS charge,
  o.total_charges,
  o.status,
  CASE WHEN o.status = 'Churned' THEN o.o_orderpriority END AS churn_category,
  CASE o.o_orderstatus {_CONTRACT_SQL} END AS contract,
  c.c_mktsegment AS payment,
  c.c_nationkey AS zip_code,
  s.population,
  l.n_lines, l.qty, l.disc,
  {_SERVICE_SQL_OUT},
  CAST(18 + o.o_custkey % 60 AS INTEGER) AS age
FROM snap_st o
JOIN customer c ON o.o_custkey = c.c_custkey
JOIN snap_cust cs ON cs.cust = o.o_custkey
LEFT JOIN snap_sup s ON s.s_nationkey = c.c_nationkey
LEFT JOIN snap_lines l ON l.l_orderkey = o.o_orderkey)"""


# ---------------------------------------------------------------------------
# Pseudo-model output for the evaluation operators (FIXTURES.md section 5).
# Never model output: a hash of the key, identical in Spark and DuckDB.

PRED_SEED = "pred"


def with_class_probabilities(df: DataFrame, label: str = "target", id_col: str = "id",
                             levels_from: DataFrame | None = None, seed=None) -> DataFrame:
    """Add pseudo-model output to each row: ``classes`` (sorted levels),
    ``probs`` (aligned probabilities) and ``predicted`` (first most likely
    class in level order).

    raw(id, c) = 1 + 3 hex digits of md5(id:c), plus 8192 on the row's own
    label for ids whose md5(id:m) first digit is below 10; prob = raw /
    sum(raw).  The level list is collected once (its size is the class
    count, bounded by the cardinality guard) and the per-class expressions
    are unrolled into plain columns, so the row work stays in whole-stage
    codegen; no join, no shuffle.  ``seed`` (a Column or string) varies
    the class hash: md5(id:seed:c)."""
    src = levels_from if levels_from is not None else df
    levels = sorted(r[0] for r in src.select(F.col(label)).distinct().collect() if r[0] is not None)
    idc = F.col(id_col)
    lucky = hex_digits_value(md5_key(idc, ":m"), 1, 1) < 10

    def raw(c: str):
        bonus = F.when((F.col(label) == F.lit(c)) & lucky, F.lit(8192)).otherwise(F.lit(0))
        h = (md5_key(idc, F.lit(":"), F.lit(c)) if seed is None
             else md5_key(idc, F.lit(":"), seed, F.lit(":"), F.lit(c)))
        return (F.lit(1) + hex_digits_value(h, 1, 3) + bonus).cast("bigint")

    raws = [raw(c) for c in levels]
    d = df.select("*", *[r.alias(f"__raw{i}") for i, r in enumerate(raws)])
    tot = sum((F.col(f"__raw{i}") for i in range(len(levels))), F.lit(0).cast("bigint"))
    d = d.withColumn("__tot", tot)
    probs = [F.col(f"__raw{i}") / F.col("__tot") for i in range(len(levels))]
    d = d.withColumn("classes", F.array(*[F.lit(c) for c in levels])).withColumn("probs", F.array(*probs))
    # first maximum in level order
    best = None
    for i in range(len(levels) - 1, -1, -1):
        better = F.lit(True)
        for j in range(len(levels)):
            if j < i:
                better = better & (F.col(f"__raw{i}") > F.col(f"__raw{j}"))
            elif j > i:
                better = better & (F.col(f"__raw{i}") >= F.col(f"__raw{j}"))
        best = F.when(better, F.lit(levels[i])) if best is None else F.when(better, F.lit(levels[i])).otherwise(best)
    d = d.withColumn("predicted", best)
    return d.drop(*[f"__raw{i}" for i in range(len(levels))], "__tot")


def class_probabilities(df: DataFrame, label: str = "target", id_col: str = "id",
                        levels_from: DataFrame | None = None) -> DataFrame:
    """Long form ``(id, actual, class, prob)`` of :func:`with_class_probabilities`."""
    v = with_class_probabilities(df, label, id_col, levels_from)
    return (v.select(F.col(id_col).alias("id"), F.col(label).alias("actual"),
                     F.explode(F.arrays_zip("classes", "probs")).alias("_p"))
            .select("id", "actual", F.col("_p.classes").alias("class"), F.col("_p.probs").alias("prob")))


def class_probabilities_sql(labeled: str, label: str = "target", levels_from: str | None = None,
                            prefix: str = "") -> str:
    """SQL twin of :func:`class_probabilities` as CTEs ``lv``/``pp``/``probs``
    and ``preds`` (id, actual, predicted), names optionally prefixed."""
    levels_from = levels_from or labeled
    lv, pp, probs, preds = (f"{prefix}{n}" for n in ("lv", "pp", "probs", "preds"))
    hexv = ("(instr('0123456789abcdef', substr({h}, 1, 1)) - 1) * 256 + "
            "(instr('0123456789abcdef', substr({h}, 2, 1)) - 1) * 16 + "
            "(instr('0123456789abcdef', substr({h}, 3, 1)) - 1)")
    h_class = f"md5(CAST(b.id AS VARCHAR) || ':' || {lv}.class)"
    h_m = "md5(CAST(b.id AS VARCHAR) || ':m')"
    return f"""
{lv} AS (SELECT DISTINCT {label} AS class FROM {levels_from}),
{pp} AS (
  SELECT b.id, b.{label} AS actual, {lv}.class,
    CAST(1 + {hexv.format(h=h_class)}
      + CASE WHEN {lv}.class = b.{label} AND instr('0123456789abcdef', substr({h_m}, 1, 1)) - 1 < 10
             THEN 8192 ELSE 0 END AS BIGINT) AS raw
  FROM {labeled} b CROSS JOIN {lv}),
{probs} AS (
  SELECT id, actual, class, raw / sum(raw) OVER (PARTITION BY id) AS prob FROM {pp}),
{preds} AS (
  SELECT id, actual, class AS predicted FROM (
    SELECT *, row_number() OVER (PARTITION BY id ORDER BY prob DESC, class) AS rk FROM {probs}) WHERE rk = 1)"""
