"""Fixture lens: the driver's TPC-H-like parquet tables seen as the nine raw
marketplace tables (FIXTURES.md section 3).

Columns without a counterpart are surrogates: deterministic functions of keys
that only exist to exercise the operators.  The production path reads the raw
CSV files instead (`mercato.sources.raw_io.read_raw`); both produce the same
`Raw` bundle, and everything downstream is identical.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mercato.functions.numeric import money

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


@dataclass
class Raw:
    orders: DataFrame
    items: DataFrame
    payments: DataFrame
    reviews: DataFrame
    customers: DataFrame
    sellers: DataFrame
    products: DataFrame
    geolocation: DataFrame
    translation: DataFrame


class _Deferred:
    def __getattr__(self, name):
        makers = self.__dict__.get("_makers", {})
        if name not in makers:
            raise AttributeError(name)
        setattr(self, name, makers[name]())
        return self.__dict__[name]


def deferred(cls, makers: dict, **given):
    """A bundle of the dataclass ``cls`` whose fields are made when they are first
    asked for: a job that needs two tables plans these two only."""
    made = object.__new__(type(cls.__name__, (_Deferred, cls), {}))
    made.__dict__.update(given, _makers=makers)
    return made


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _hours(ts, n):
    return F.timestamp_add("HOUR", n.cast("int"), ts)


def _days(ts, n):
    return F.timestamp_add("DAY", n.cast("int"), ts)


def customers(spark, sf_dir) -> DataFrame:
    c = read_table(spark, sf_dir, "customer")
    n = read_table(spark, sf_dir, "nation")
    return c.join(n, c.c_nationkey == n.n_nationkey).select(
        F.col("c_custkey").alias("customer_id"),
        F.floor(F.col("c_custkey") / 2).cast("long").alias("customer_unique_id"),
        F.col("c_nationkey").alias("customer_zip_code_prefix"),
        F.col("c_mktsegment").alias("customer_city"),
        F.col("n_name").alias("customer_state"),
    )


def sellers(spark, sf_dir) -> DataFrame:
    s = read_table(spark, sf_dir, "supplier")
    n = read_table(spark, sf_dir, "nation")
    return s.join(n, s.s_nationkey == n.n_nationkey).select(
        F.col("s_suppkey").alias("seller_id"),
        F.col("s_nationkey").alias("seller_zip_code_prefix"),
        F.concat(F.lit("CITY_"), (F.col("s_suppkey") % 7).cast("string")).alias("seller_city"),
        F.col("n_name").alias("seller_state"),
    )


def products(spark, sf_dir) -> DataFrame:
    p = read_table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    return p.select(
        k.alias("product_id"),
        F.when(k % 67 == 5, F.lit(None).cast("string"))
        .otherwise(F.concat("p_type", F.lit("_"), "p_brand"))
        .alias("product_category_name"),
        F.when(k % 41 == 3, F.lit(None).cast("double"))
        .otherwise((F.col("p_size") * 100).cast("double"))
        .alias("product_weight_g"),
        (F.col("p_size") + 5).cast("double").alias("product_length_cm"),
        (k % 30 + 2).cast("double").alias("product_height_cm"),
        F.when(k % 53 == 9, F.lit(None).cast("double"))
        .otherwise((k % 25 + 6).cast("double"))
        .alias("product_width_cm"),
    )


def translation(spark, sf_dir) -> DataFrame:
    p = read_table(spark, sf_dir, "part")
    return (
        p.filter(F.col("p_type") != "PROMO")
        .select(
            F.concat("p_type", F.lit("_"), "p_brand").alias("product_category_name"),
            F.lower(F.concat("p_brand", F.lit("_"), "p_type")).alias("product_category_name_english"),
        )
        .distinct()
    )


def items(spark, sf_dir) -> DataFrame:
    # named before the window: its partitions then serve joins on order_id as they are
    li = read_table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "order_id")
    # (l_orderkey, l_linenumber) is not unique: renumber the lines per order.  Lines that are equal in these columns are
    # equal in every column of an item, so no other column needs to be dealt to tell them apart.
    w = Window.partitionBy("order_id").orderBy(
        "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity", "l_discount", "l_tax",
    )
    price = money("l_extendedprice")
    return li.select(
        "order_id",
        F.row_number().over(w).cast("int").alias("order_item_id"),
        F.col("l_partkey").alias("product_id"),
        F.col("l_suppkey").alias("seller_id"),
        F.col("l_shipdate").alias("shipping_limit_date"),
        price.alias("price"),
        F.round(price * F.col("l_tax").cast("decimal(4,2)"), 2).cast("decimal(12,2)").alias("freight_value"),
    )


def orders(spark, sf_dir) -> DataFrame:
    li = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_shipdate")
    part = read_table(spark, sf_dir, "part").select("p_partkey", "p_type")
    bulk = (
        F.when(F.col("p_type") == "LARGE", 5)
        .when(F.col("p_type") == "ECONOMY", 3)
        .when(F.col("p_type") == "PROMO", 1)
        .otherwise(0)
    )
    sh = (
        li.join(part, li.l_partkey == part.p_partkey)
        .groupBy("l_orderkey")
        .agg(
            F.max("l_shipdate").alias("last_ship"),
            F.min("l_suppkey").alias("first_supplier"),
            F.max(bulk).alias("bulk_days"),
        )
    )
    o = read_table(spark, sf_dir, "orders")
    st, pr, key = F.col("o_orderstatus"), F.col("o_orderpriority"), F.col("o_orderkey")
    status = (
        F.when((st == "P") & (pr == "5-LOW"), "canceled")
        .when((st == "P") & (pr == "4-NOT SPECIFIED") & (key % 2 == 0), "unavailable")
        .when((st == "O") & (pr == "1-URGENT"), "shipped")
        .otherwise("delivered")
    )
    b = o.join(sh, o.o_orderkey == sh.l_orderkey, "left").select(
        key.alias("order_id"),
        F.col("o_custkey").alias("customer_id"),
        "o_orderdate",
        "last_ship",
        "bulk_days",
        F.when(F.col("first_supplier") % 10 == 0, 6).otherwise(0).alias("slow_days"),
        status.alias("order_status"),
        _hours(F.col("o_orderdate"), key % 24).alias("order_purchase_timestamp"),
    )
    oid, purchase = F.col("order_id"), F.col("order_purchase_timestamp")
    delivered = _hours(
        _days(purchase, F.dayofyear("last_ship") % 45 + F.col("bulk_days") + F.col("slow_days")
              + F.when(oid % 701 == 9, 190).otherwise(0)), oid % 13
    )
    return b.select(
        "order_id",
        "customer_id",
        "order_status",
        "order_purchase_timestamp",
        F.when(oid % 500 == 7, F.lit(None).cast("timestamp_ntz"))
        .otherwise(_hours(purchase, oid % 37))
        .alias("order_approved_at"),
        F.lit(None).cast("timestamp_ntz").alias("order_delivered_carrier_date"),
        F.when((F.col("order_status") != "delivered") | (oid % 1000 == 3), F.lit(None).cast("timestamp_ntz"))
        .otherwise(delivered)
        .alias("order_delivered_customer_date"),
        _days(F.col("o_orderdate"), oid % 4 * 2 + 42).alias("order_estimated_delivery_date"),
    )


def payments(spark, sf_dir) -> DataFrame:
    li = read_table(spark, sf_dir, "lineitem")
    rf, ls = F.col("l_returnflag"), F.col("l_linestatus")
    ptype = (
        F.when((rf == "N") & (ls == "O") & (F.col("l_quantity") < 3), "not_defined")
        .when(rf == "R", "credit_card")
        .when(rf == "A", "boleto")
        .otherwise("voucher")
    )
    value = F.round(money("l_extendedprice") * (1 - F.col("l_discount").cast("decimal(4,2)")), 2)
    return li.select(
        F.col("l_orderkey").alias("order_id"),
        ptype.alias("payment_type"),
        (F.col("l_quantity").cast("int") % 24 + 1).alias("payment_installments"),
        value.cast("decimal(12,2)").alias("payment_value"),
    )


def reviews(spark, sf_dir) -> DataFrame:
    e = read_table(spark, sf_dir, "events")
    eid = F.col("event_id")
    return e.select(
        F.when(eid % 50 == 1, eid - 1).otherwise(eid).alias("review_id"),
        F.floor(eid / 2).cast("long").alias("order_id"),
        (eid % 5 + 1).cast("int").alias("review_score"),
        F.lit(None).cast("string").alias("review_comment_title"),
        F.when(F.col("event_type") == "error", F.lit(None).cast("string"))
        .otherwise(F.col("event_type"))
        .alias("review_comment_message"),
        F.col("ts").alias("review_creation_date"),
        F.lit(None).cast("timestamp_ntz").alias("review_answer_timestamp"),
    )


def geolocation(spark, sf_dir) -> DataFrame:
    c = read_table(spark, sf_dir, "customer")
    n = read_table(spark, sf_dir, "nation")
    bal = money("c_acctbal")
    g = c.join(n, c.c_nationkey == n.n_nationkey).select(
        F.col("c_nationkey").alias("geolocation_zip_code_prefix"),
        (bal * F.lit(0.004).cast("decimal(4,3)") - 20).cast("double").alias("geolocation_lat"),
        (F.lit(-50) - bal * F.lit(0.003).cast("decimal(4,3)")).cast("double").alias("geolocation_lng"),
        F.col("c_mktsegment").alias("geolocation_city"),
        F.col("n_name").alias("geolocation_state"),
        "c_custkey",
    )
    cols = [c for c in g.columns if c != "c_custkey"]
    return g.select(cols).unionByName(g.filter(F.col("c_custkey") % 4 == 0).select(cols))


def load(spark: SparkSession, sf_dir: str) -> Raw:
    makers = {"orders": orders, "items": items, "payments": payments, "reviews": reviews, "customers": customers,
              "sellers": sellers, "products": products, "geolocation": geolocation, "translation": translation}
    return deferred(Raw, {name: lambda fn=fn: fn(spark, sf_dir) for name, fn in makers.items()})
