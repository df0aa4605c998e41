"""The star schema: eight tables, built lazily from a `Raw` bundle.

`build` returns lazy DataFrames.  `save` writes each table once as parquet
(fact_orders partitioned by purchase month so month filters prune files);
`load` reads them back, so the analytics can run from the materialised star
instead of re-cleaning the raw files.
"""

from __future__ import annotations

import datetime as dt
import uuid
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mercato.params import Params
from mercato.plans import clean
from mercato.session import ensure_checkpoint_dir, run_concurrently
from mercato.sources.lens import Raw, deferred

#: Partition column of the stored fact_orders.
MONTH = "purchase_month"


@dataclass
class Star:
    dim_customers: DataFrame
    dim_sellers: DataFrame
    dim_products: DataFrame
    dim_geolocation: DataFrame
    fact_orders: DataFrame
    fact_order_items: DataFrame
    bridge_payments: DataFrame
    bridge_reviews: DataFrame
    # the raw bundle the star was cleaned from (quality reports need both sides)
    raw: Raw | None = None

    def tables(self) -> dict[str, DataFrame]:
        return {f.name: getattr(self, f.name) for f in fields(self) if f.name != "raw"}

    def register(self, prefix: str = "") -> None:
        """Named temp views over the star."""
        for name, df in self.tables().items():
            df.createOrReplaceTempView(prefix + name)

    def save(self, path: str, mode: str = "overwrite", parallel: int = 8) -> None:
        """Idempotent overwrite of every table (T21: never append twice).

        The eight writes are independent Spark jobs; they are submitted from a
        small thread pool so small dimension writes do not leave the cluster
        idle while a large fact table is written."""
        def write(item):
            name, df = item
            w = df.write.mode(mode)
            if name == "fact_orders":
                # one folder per month, written by few tasks each: rows meet by month first, and a large
                # month is split again by adaptive execution
                df = df.withColumn(MONTH, purchase_month()).hint("rebalance", MONTH)
                w = df.write.mode(mode).partitionBy(MONTH)
            w.parquet(f"{path.rstrip('/')}/{name}")

        items = list(self.tables().items())
        spark = items[0][1].sparkSession
        run_concurrently(spark, [lambda it=it: write(it) for it in items], max_workers=parallel)

    ORDER_KEYED = ("fact_orders", "fact_order_items", "bridge_payments", "bridge_reviews")

    def save_tables(self, spark: SparkSession, database: str, buckets: int, location: str | None = None) -> None:
        """Catalog tables for repeated analytics at scale: the four order-keyed
        tables are bucketed and sorted by order_id with the same bucket count, so
        their joins on order_id run as sort-merge joins without an exchange;
        the dimensions are plain tables (AQE broadcasts them when small)."""
        loc = f" LOCATION '{location}'" if location else ""
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}{loc}")
        for name, df in self.tables().items():
            w = df.write.mode("overwrite").format("parquet")
            if name in self.ORDER_KEYED:
                w = w.bucketBy(buckets, "order_id").sortBy("order_id")
            w.saveAsTable(f"{database}.{name}")

    @classmethod
    def load_tables(cls, spark: SparkSession, database: str) -> "Star":
        return cls(**{f.name: spark.table(f"{database}.{f.name}") for f in fields(cls) if f.name != "raw"})

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "Star":
        t = {}
        for f in fields(cls):
            if f.name == "raw":
                continue
            df = spark.read.parquet(f"{path.rstrip('/')}/{f.name}")
            t[f.name] = df
        return cls(**t)

    def orders_between(self, start: dt.date, end: dt.date) -> DataFrame:
        """Orders purchased on [start, end); on a stored star only the folders
        of these months are read."""
        t = F.col("order_purchase_timestamp")
        x = self.fact_orders.filter((t >= F.lit(start).cast("timestamp_ntz")) & (t < F.lit(end).cast("timestamp_ntz")))
        if MONTH in x.columns:
            x = x.filter(F.col(MONTH).between(F.lit(start.replace(day=1)), F.lit(end))).drop(MONTH)
        return x


def purchase_month():
    return F.trunc(F.to_date("order_purchase_timestamp"), "month")


def stored(s: Star) -> Star:
    """``s`` written to the shared checkpoint folder and read again."""
    spark = s.fact_orders.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/star-{uuid.uuid4().hex}"
    s.save(path)
    return Star.load(spark, path)


def build(raw: Raw, p: Params) -> Star:
    star = deferred(Star, {
        "dim_customers": lambda: raw.customers,
        "dim_sellers": lambda: raw.sellers,
        "dim_products": lambda: clean.clean_products(raw.products, raw.translation, p),
        "dim_geolocation": lambda: clean.clean_geolocation(raw.geolocation, p),
        "fact_orders": lambda: clean.fact_orders(raw.orders, raw.items, star.bridge_payments, p),
        "fact_order_items": lambda: raw.items,
        "bridge_payments": lambda: clean.payments_by_order(raw.payments, p),
        "bridge_reviews": lambda: clean.clean_reviews(raw.reviews),
    }, raw=raw)
    return star
