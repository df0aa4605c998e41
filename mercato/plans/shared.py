"""Analytical views, each stored once per version of what it reads.

Reports call these functions under the names of mercato.plans.views.  The rows
of a view are written to the shared folder and published in one step (see
mercato.ml.store); the key is a digest of the parameters, of what the view is
computed as and of every file below it.  The next report over the same data
reads the stored rows; changed data or parameters make a new view.  Views
read only the columns and rows that a report asks for, as any Parquet table.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import fields

from pyspark.sql import DataFrame

from mercato.ml.store import Manifest, ModelStore, now, table_version
from mercato.params import Params
from mercato.plans import clean
from mercato.plans import views as V
from mercato.session import ensure_checkpoint_dir, store
from mercato.sources.lens import deferred
from mercato.sources.star import Star


def once(name: str, base: DataFrame, p: Params | None, rows: Callable[[], DataFrame] | None = None,
         folder: str = "views") -> DataFrame:
    """The rows of ``base``, or those that ``rows`` makes of it, stored under its version."""
    spark = base.sparkSession
    runs = ModelStore(spark, f"{ensure_checkpoint_dir(spark).rstrip('/')}/{folder}")
    inputs = {name: table_version(base)}
    key = ModelStore.key(name, repr(p), inputs)
    known = runs.find(key)
    if known is None:
        run = runs.new_run()
        store(rows() if rows else base, run)
        known = runs.publish(Manifest(key, run, now(), name, inputs, repr(p)))
    return spark.read.parquet(known.run)


def orders_once(s: Star, p: Params) -> Star:
    """``s`` with its raw orders stored once a version, when its orders are first asked for: the views of one report
    then read the dates of the orders, and none makes them anew.  Stored views are found by ``s`` (see `_asked`).
    A star whose orders are not made from its raw ones, as a loaded one, stays as it is."""
    def fact_orders() -> DataFrame:
        raw = s.raw
        if raw is None or not s.fact_orders.sameSemantics(clean.fact_orders(raw.orders, raw.items, s.bridge_payments, p)):
            return s.fact_orders
        return clean.fact_orders(once("raw_orders", raw.orders, None, folder="tables"), raw.items, s.bridge_payments, p)

    made = {f.name: lambda name=f.name: getattr(s, name) for f in fields(Star) if f.name not in ("raw", "fact_orders")}
    return deferred(Star, {**made, "fact_orders": fact_orders}, raw=s.raw, asked=s)


def _asked(s: Star) -> Star:
    """The star by which a stored view is found, whatever its rows are made from."""
    return s.__dict__.get("asked", s)


def rfm_scores(s: Star, p: Params) -> DataFrame:
    return once("rfm_scores", V.rfm_raw(s, p), p, lambda: V.rfm_scores(s, p))


def category_sla(s: Star, p: Params) -> DataFrame:
    return once("category_sla", V.category_sla(_asked(s), p), p, lambda: V.category_sla(s, p))


def cohort_retention(s: Star, p: Params) -> DataFrame:
    return once("cohort_retention", V.cohort_retention(s, p), p)


def revenue_by_category(s: Star, p: Params) -> DataFrame:
    return once("revenue_by_category", V.revenue_by_category(s, p), p)


def seller_performance(s: Star, p: Params) -> DataFrame:
    return once("seller_performance", V.seller_performance(_asked(s), p), p, lambda: V.seller_performance(s, p))


def cancellation_analysis(s: Star, p: Params) -> DataFrame:
    return once("cancellation_analysis", V.cancellation_analysis(s, p), p)


def delivery_delay_drivers(s: Star, p: Params) -> DataFrame:
    return once("delivery_delay_drivers", V.delivery_delay_drivers(_asked(s), p), p, lambda: V.delivery_delay_drivers(s, p))


def unified_rows(s: Star, p: Params) -> DataFrame:
    """The unified table over the stored RFM and SLA rows, not stored itself: a report that reads it once has
    only its own columns made and shuffled, and the same whatever report ran before."""
    return V.unified_orders(s, p, rfm_scores(s, p), category_sla(s, p))


def unified_orders(s: Star, p: Params) -> DataFrame:
    """The unified table over the stored RFM and SLA rows; the orders are made once for it and the SLA rows."""
    made = orders_once(s, p)
    rfm, sla = rfm_scores(s, p), category_sla(made, p)
    return once("unified_orders", V.unified_orders(s, p, rfm, sla), p, lambda: V.unified_orders(made, p, rfm, sla))
