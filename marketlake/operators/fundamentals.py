"""Company financials: statement joins, estimates, XBRL fact extraction (J4, J5, J11,
N15, N17, U3, X1-X4)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .merge import latest_wins

# ---- fixed values that must equal the reference's --------------------------------
# Statement vendor columns → canonical financial columns.
STATEMENT_COLUMNS = {
    "sales": "revenue", "net_income": "net_income", "diluted_net_eps": "eps",
    "total_assets": "total_assets", "total_liabilities": "total_liabilities", "total_equity": "equity",
    "cash_and_equivalents": "cash", "long_term_debt": "total_debt",
    "net_change_in_cash_and_equivalents": "net_change_cash",
    "net_cash_from_operating_activities": "operating_cf", "property_and_equipment": "capex",
}
# XBRL concepts per metric, in order of preference.
METRIC_CONCEPTS = {
    "revenue": ["Revenues", "RevenueFromContractWithCustomerExcludingAssessedTax", "SalesRevenueNet",
                "SalesRevenueGoodsNet"],
    "net_income": ["NetIncomeLoss"],
    "eps": ["EarningsPerShareDiluted"],
    "total_assets": ["Assets"],
    "total_liabilities": ["Liabilities"],
    "equity": ["StockholdersEquity"],
    "cash": ["CashAndCashEquivalentsAtCarryingValue"],
    "total_debt": ["LongTermDebtNoncurrent", "LongTermDebt"],
    "operating_cf": ["NetCashProvidedByUsedInOperatingActivities"],
    "capex": ["PaymentsToAcquirePropertyPlantAndEquipment"],
}
TAXONOMY_PREFERENCE = ["us-gaap", "dei"]
ALLOWED_FORMS = ["10-Q", "10-K"]
FINANCIAL_ORDER = ["symbol", "report_date", "fiscal_period", "revenue", "net_income", "eps", "total_assets",
                   "total_liabilities", "equity", "cash", "total_debt", "net_change_cash", "operating_cf", "capex",
                   "free_cash_flow", "eps_estimate", "actual_eps", "eps_surprise"]
EMPTY_ROW_COLUMNS = ["revenue", "net_income", "total_assets"]
# ----------------------------------------------------------------------------------

STATEMENT_KEY = ["act_symbol", "date", "period"]


def free_cash_flow(operating_cf="operating_cf", capex="capex"):
    """Operating cash flow − |capex| (missing capex counts 0; null if no operating CF)."""
    return F.col(operating_cf) - F.coalesce(F.abs(F.col(capex)), F.lit(0.0))


def _canonical(df: DataFrame) -> list:
    out = []
    for c in df.columns:
        if c in STATEMENT_KEY:
            continue
        out.append(F.col(c).alias(STATEMENT_COLUMNS.get(c, c)))
    return out


def statements_join(income: DataFrame, others: Sequence[DataFrame] = (), estimates: DataFrame | None = None) -> DataFrame:
    """J4 + J5: income statement left-joined to the other statements on
    (symbol, date, period), FCF derived, estimates joined on (symbol, report_date)."""
    d = income
    for o in others:
        d = d.join(o, on=STATEMENT_KEY, how="left")
    d = d.select(F.col("act_symbol").alias("symbol"), F.col("date").alias("report_date"),
                 F.col("period").alias("fiscal_period"), *_canonical(d))
    if "operating_cf" in d.columns:
        d = d.withColumn("free_cash_flow", free_cash_flow("operating_cf", "capex") if "capex" in d.columns
                         else F.col("operating_cf"))
    if estimates is not None:
        d = d.join(eps_surprise(estimates), on=["symbol", "report_date"], how="left")
    return d.select(*[c for c in FINANCIAL_ORDER if c in d.columns],
                    *[c for c in d.columns if c not in FINANCIAL_ORDER])


def eps_surprise(eps_history: DataFrame) -> DataFrame:
    """Estimates table → symbol, report_date, eps_estimate, actual_eps, eps_surprise."""
    sym = "act_symbol" if "act_symbol" in eps_history.columns else "symbol"
    return eps_history.select(F.col(sym).alias("symbol"), F.col("period_end_date").alias("report_date"),
                              F.col("estimate").alias("eps_estimate"), F.col("reported").alias("actual_eps"),
                              (F.col("reported") - F.col("estimate")).alias("eps_surprise"))


def metric_dimension(spark: SparkSession) -> DataFrame:
    """(metric, concept, pref) rows from METRIC_CONCEPTS (a fixed, tiny table)."""
    rows = [(m, c, i) for m, cs in METRIC_CONCEPTS.items() for i, c in enumerate(cs)]
    return spark.createDataFrame(rows, "metric string, concept string, pref int")


def extract_facts(facts: DataFrame, forms: Sequence[str] = ALLOWED_FORMS) -> DataFrame:
    """X1 + X3 (+ F8 form filter): long XBRL facts → (symbol, metric, end_date, val, form).

    Columns of ``facts``: symbol, concept, form, end_date, val, pos (report order) and
    optionally taxonomy and unit / unit_pos. Per symbol the taxonomy is us-gaap if it
    has any fact, else dei. Per (symbol, metric): the first concept by preference that
    has a row of an allowed form, and in it the first unit having one; per end date the
    last report (highest ``pos``) wins.

    One aggregation over the facts; the choices are windows over its result, which has one
    row per (symbol, taxonomy, concept, unit, end date). The result is dealt by symbol over all shuffle partitions, in
    narrow rows that are sorted once for both windows: AQE would bring them together in a few large tasks.
    """
    one_taxonomy = "taxonomy" not in facts.columns
    f = facts.withColumn("taxonomy", F.lit(TAXONOMY_PREFERENCE[0])) if one_taxonomy else facts
    if "unit_pos" not in f.columns:
        f = f.withColumn("unit_pos", F.lit(0))
    allowed = F.when(F.col("form").isin(list(forms)), F.col("pos"))
    last = (f.filter(F.col("taxonomy").isin(TAXONOMY_PREFERENCE))
            .groupBy("symbol", "taxonomy", "concept", "unit_pos", "end_date")
            .agg(F.max_by(F.struct("val", "form"), allowed).alias("__v"), F.count(allowed).alias("__n")))
    rank = F.array_position(F.array(*map(F.lit, TAXONOMY_PREFERENCE)), F.col("taxonomy")).cast("int")
    tasks = int(facts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dimension = F.broadcast(metric_dimension(facts.sparkSession))                                  # fixed, ~15 rows
    # facts of other concepts, or of no allowed form, count for the taxonomy of their symbol alone
    known = last.join(dimension, "concept", "inner" if one_taxonomy else "left").withColumn("__tax", rank)
    usable = (F.col("__n") > 0) & F.col("metric").isNotNull()
    if one_taxonomy:
        known = known.filter(usable)
    rows = (known.select("symbol", "metric", "pref", "unit_pos", "end_date", "__v", "__tax", F.when(usable, True).alias("__usable"))
            .repartition(tasks, "symbol").sortWithinPartitions("symbol", "metric"))
    if not one_taxonomy:
        rows = rows.withColumn("__first", F.min("__tax").over(Window.partitionBy("symbol"))).filter(
            (F.col("__tax") == F.col("__first")) & F.col("__usable"))
    choice = F.struct("pref", "unit_pos")
    chosen = rows.withColumn("__best", F.min(choice).over(Window.partitionBy("symbol", "metric")))
    return chosen.filter(choice == F.col("__best")).select(
        "symbol", "metric", "end_date", F.col("__v.val").alias("val"), F.col("__v.form").alias("form"))


def facts_to_financials(extracted: DataFrame) -> DataFrame:
    """Pivot the metrics (the union of metric dates is the pivot's rows) onto (symbol, report_date), numeric cast, FCF, null
    estimates, drop rows with none of revenue / net income / total assets.

    fiscal_period is derived from the form (10-K ⇒ FY, else Q) instead of the
    reference's always-'FY' date test (Q18).
    """
    metrics = list(METRIC_CONCEPTS)
    d = extracted.groupBy("symbol", F.col("end_date").alias("report_date")).agg(
        *[F.max(F.when(F.col("metric") == m, F.col("val"))).alias(m) for m in metrics],
        F.max(F.when(F.col("form") == "10-K", 1).otherwise(0)).alias("__fy"))
    d = d.select("symbol", "report_date",
                 F.when(F.col("__fy") == 1, F.lit("FY")).otherwise(F.lit("Q")).alias("fiscal_period"),
                 *[F.col(m).try_cast("double").alias(m) for m in metrics])
    d = (d.withColumn("free_cash_flow", free_cash_flow())
         .withColumn("eps_estimate", F.lit(None).cast("double"))
         .withColumn("actual_eps", F.lit(None).cast("double"))
         .withColumn("eps_surprise", F.lit(None).cast("double")))
    return d.dropna(how="all", subset=EMPTY_ROW_COLUMNS)          # F7


def merge_financials(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Existing ++ new, the new row wins per (symbol, report_date)."""
    return latest_wins(existing, new, ["symbol", "report_date"])
