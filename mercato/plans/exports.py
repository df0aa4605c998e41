"""The six dashboard extracts plus the unified table, written as CSV
with a per-file row/column/digest report, taken in the write pass, and a
read-back check of the content (S4-S8)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mercato.params import Params
from mercato.plans import views as V
from mercato.sources import raw_io
from mercato.sources.star import Star


#: Extracts whose rows are months, categories or states: one file each.
SMALL = {"cohort_retention", "revenue_by_category", "category_sla", "cancellation_analysis"}


def extracts(s: Star, p: Params) -> dict[str, tuple[str, DataFrame]]:
    """name -> (target folder, DataFrame), in the order of the export notebook.
    Sorted only here, at the sink (the views themselves promise no order)."""
    rfm = V.rfm_scores(s, p)
    cr = V.cohort_retention(s, p).filter(~F.col("cohort_month").isin([F.lit(d) for d in p.cohort_exclude]))
    return {
        "rfm_segments": ("tableau", rfm),
        "cohort_retention": ("tableau", cr.orderBy("cohort_month", "period_number")),
        "revenue_by_category": ("tableau", V.revenue_by_category(s, p).orderBy("order_month",
                                                                                "product_category_name")),
        "category_sla": ("tableau", V.category_sla(s, p).orderBy(F.col("late_rate_pct").desc(),
                                                                 "product_category_name")),
        "seller_performance": ("looker", V.seller_performance(s, p).orderBy(F.col("late_rate_pct").desc(),
                                                                            "seller_id")),
        "cancellation_analysis": ("looker", V.cancellation_analysis(s, p).orderBy(
            "analysis_dimension", F.col("cancel_rate_pct").desc(), "dimension_value")),
        "unified_tableau": ("tableau", V.unified_orders(s, p, rfm, V.category_sla(s, p))),
    }


def export_extracts(spark: SparkSession, s: Star, p: Params, out_dir: str, bom: bool = True) -> DataFrame:
    """Write every extract, then verify it by reading it back.  Extracts with a
    row per person, seller or item grow with the data and become CSV folders;
    those per month, category and state become single BOM files."""
    from mercato.session import run_concurrently

    def one(item):
        name, (target, df) = item
        path = f"{out_dir.rstrip('/')}/{target}/{name}"
        small = name in SMALL
        stats = raw_io.observed_write(df, path, bom=bom and small)
        back = raw_io.read_back_check(spark, path, stats, df.columns)
        return (name, target, stats["rows"], stats["cols"], stats["digest"], back["ok"])

    # independent extracts: submitted as concurrent Spark jobs
    report = run_concurrently(spark, [lambda it=it: one(it) for it in extracts(s, p).items()], max_workers=4)
    return spark.createDataFrame(report, "file string, destination string, rows long, cols int, digest string, read_back_ok boolean")
