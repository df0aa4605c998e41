"""Raw tables -> cleaned star tables.

All steps are lazy DataFrame transformations; the only "driver" values are
scalar subqueries (global medians), which Spark evaluates once and broadcasts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mercato.functions.timefx import floor_days, hours_between
from mercato.operators.counted import grouped_medians, grouped_modes
from mercato.params import Params

DIM_COLS = ("product_weight_g", "product_length_cm", "product_height_cm", "product_width_cm")


def in_box(lat, lng, box_lat, box_lng):
    return F.col(lat).between(*box_lat) & F.col(lng).between(*box_lng)


def clean_geolocation(geo: DataFrame, p: Params) -> DataFrame:
    """Exact-row distinct -> bounding box -> one row per zip prefix.

    Coordinates are the per-zip medians, city and state the most frequent value
    (lowest on ties).  Result grain: zip_code_prefix.
    """
    kept = geo.distinct().filter(in_box("geolocation_lat", "geolocation_lng", p.box_lat, p.box_lng))
    kept = kept.withColumnRenamed("geolocation_zip_code_prefix", "zip_code_prefix")
    at = grouped_medians(kept, ["zip_code_prefix"], ["geolocation_lat", "geolocation_lng"])
    named = grouped_modes(kept, ["zip_code_prefix"], ["geolocation_city", "geolocation_state"])
    joined = at.alias("a").join(named.alias("b"), F.col("a.zip_code_prefix").eqNullSafe(F.col("b.zip_code_prefix")))
    return joined.select(
        "a.zip_code_prefix",
        F.round("geolocation_lat", 6).alias("geolocation_lat"),
        F.round("geolocation_lng", 6).alias("geolocation_lng"),
        "geolocation_city",
        "geolocation_state",
    )


def clean_reviews(reviews: DataFrame) -> DataFrame:
    """One row per review_id, the first by (creation date, order id, ...).

    Done as a min over a struct (an aggregate with map-side combine), so a
    review id with many copies never lands whole in one task.
    """
    order = ["review_creation_date", "order_id", "review_score", "review_comment_message",
             "review_comment_title", "review_answer_timestamp"]
    first = reviews.groupBy("review_id").agg(F.min(F.struct(*order)).alias("r"))
    return first.select(
        "review_id",
        "r.order_id",
        "r.review_score",
        "r.review_comment_title",
        "r.review_comment_message",
        "r.review_creation_date",
        "r.review_answer_timestamp",
        F.col("r.review_comment_message").isNotNull().alias("has_comment"),
    )


def payments_by_order(payments: DataFrame, p: Params) -> DataFrame:
    """Drop not_defined, then one row per order.

    Two partial aggregations instead of one with a distinct count and a mode:
    (order, type) first -- map-side combined, so even an order with a huge
    number of payment rows arrives pre-reduced -- then order.  The primary type
    is the most frequent one, the lowest name on ties."""
    kept = payments.filter(~F.col("payment_type").eqNullSafe(p.not_defined_payment))
    per_type = kept.groupBy("order_id", "payment_type").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("payment_value").alias("v"),
        F.max("payment_installments").alias("i"),
    )
    t = F.col("payment_type")
    return per_type.groupBy("order_id").agg(
        F.sum("v").cast("decimal(12,2)").alias("payment_value"),
        F.max("i").cast("int").alias("payment_installments"),
        F.min_by(t, F.when(t.isNotNull(), F.struct(-F.col("n"), t))).alias("payment_type_primary"),
        F.count(t).cast("int").alias("payment_type_count"),
    )


def clean_products(products: DataFrame, translation: DataFrame, p: Params) -> DataFrame:
    """C4: English names (translation, manual map, 'uncategorized'), then
    dimension nulls -> category median -> global median."""
    manual = F.create_map(*[F.lit(x) for kv in p.manual_translations for x in kv])
    joined = products.join(translation, "product_category_name", "left")
    english = F.coalesce(
        F.col("product_category_name_english"),
        F.element_at(manual, F.col("product_category_name")) if p.manual_translations else F.lit(None),
        F.lit(p.uncategorized),
    )
    named = joined.withColumn("product_category_name_english", english)
    dims = [c for c in DIM_COLS if c in named.columns]
    cat_medians = grouped_medians(named, ["product_category_name_english"], dims).withColumnsRenamed(
        {c: f"_cm_{c}" for c in dims})
    # all global medians in one scalar subquery (one job, evaluated once)
    global_medians = grouped_medians(named, [], dims).select(F.struct(*dims)).scalar()
    out = named.join(cat_medians, "product_category_name_english", "left")
    for c in dims:
        out = out.withColumn(
            c, F.coalesce(F.col(c), F.col(f"_cm_{c}"), global_medians.getField(c)).cast("decimal(10,2)"))
    front = ["product_id", "product_category_name", "product_category_name_english"]
    rest = [c for c in products.columns if c not in front and c not in dims]
    return out.select(*front, *rest, *dims)


def fact_orders(orders: DataFrame, items: DataFrame, payments_agg: DataFrame, p: Params) -> DataFrame:
    """Integrity flags, delivery measures and placeholder nulling."""
    o = orders.alias("o")
    # an order's items are made one row before they are dealt by order
    ordered = items.select("order_id").distinct()
    has_items = ordered.where(F.col("order_id") == F.col("o.order_id").outer()).exists()
    has_payment = payments_agg.where(F.col("order_id") == F.col("o.order_id").outer()).exists()
    delivered_at = F.col("order_delivered_customer_date")
    days_to_deliver = floor_days("order_purchase_timestamp", delivered_at)
    days_vs_estimate = floor_days("order_estimated_delivery_date", delivered_at)
    placeholder = (F.col("order_status") == p.delivered_status) & F.to_date(delivered_at).isin(
        [F.lit(d) for d in p.placeholder_dates]
    )
    placeholder = F.coalesce(placeholder, F.lit(False))
    base = o.select(
        "*",
        has_items.alias("has_items"),
        has_payment.alias("has_payment"),
        placeholder.alias("has_placeholder_delivery_date"),
        days_to_deliver.alias("_dtd"),
        days_vs_estimate.alias("_dve"),
        hours_between("order_purchase_timestamp", "order_approved_at").alias("approval_lag_hours"),
    )
    ph = F.col("has_placeholder_delivery_date")
    # Negative delivery time is a data error: NULL (and counted by the quality report).
    dtd = F.when(~ph & (F.col("_dtd") >= 0), F.col("_dtd"))
    dve = F.when(~ph, F.col("_dve"))
    # A missing delivery date compares to False, not NULL (pandas NaN > 0).
    late = F.when(~ph, F.coalesce(F.col("_dve") > 0, F.lit(False)))
    return base.select(
        "order_id", "customer_id", "order_status", "order_purchase_timestamp", "order_approved_at",
        "order_delivered_carrier_date", "order_delivered_customer_date", "order_estimated_delivery_date",
        "has_items", "has_payment", "has_placeholder_delivery_date",
        dtd.cast("int").alias("days_to_deliver"),
        dve.cast("int").alias("days_vs_estimate"),
        late.alias("is_late"),
        "approval_lag_hours",
    )
