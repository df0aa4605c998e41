"""Raw CSV sources and CSV sinks.

Production input is the nine headered CSV files of the marketplace export.
They are read with explicit schemas (never inferSchema); timestamps are read
as text and parsed with `try_to_timestamp`, so unparseable values become NULL
instead of failing the job under ANSI mode.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructField, StructType

from mercato.functions.numeric import money
from mercato.sources.lens import Raw

TS_FORMAT = "yyyy-MM-dd HH:mm:ss"

# Default file names; pass `files=` to read_raw to map the names of a given export.
RAW_FILES = {name: f"{name}.csv" for name in (
    "orders", "items", "payments", "reviews", "customers", "sellers", "products", "geolocation", "translation")}


def _schema(*cols: tuple[str, object]) -> StructType:
    return StructType([StructField(n, t, True) for n, t in cols])


S, I, D = StringType(), IntegerType(), DoubleType()
RAW_SCHEMAS = {
    "orders": _schema(("order_id", S), ("customer_id", S), ("order_status", S), ("order_purchase_timestamp", S),
                      ("order_approved_at", S), ("order_delivered_carrier_date", S),
                      ("order_delivered_customer_date", S), ("order_estimated_delivery_date", S)),
    "items": _schema(("order_id", S), ("order_item_id", I), ("product_id", S), ("seller_id", S),
                     ("shipping_limit_date", S), ("price", S), ("freight_value", S)),
    "payments": _schema(("order_id", S), ("payment_sequential", I), ("payment_type", S),
                        ("payment_installments", I), ("payment_value", S)),
    "reviews": _schema(("review_id", S), ("order_id", S), ("review_score", I), ("review_comment_title", S),
                       ("review_comment_message", S), ("review_creation_date", S), ("review_answer_timestamp", S)),
    "customers": _schema(("customer_id", S), ("customer_unique_id", S), ("customer_zip_code_prefix", I),
                         ("customer_city", S), ("customer_state", S)),
    "sellers": _schema(("seller_id", S), ("seller_zip_code_prefix", I), ("seller_city", S), ("seller_state", S)),
    "products": _schema(("product_id", S), ("product_category_name", S), ("product_name_lenght", I),
                        ("product_description_lenght", I), ("product_photos_qty", I), ("product_weight_g", D),
                        ("product_length_cm", D), ("product_height_cm", D), ("product_width_cm", D)),
    "geolocation": _schema(("geolocation_zip_code_prefix", I), ("geolocation_lat", D), ("geolocation_lng", D),
                           ("geolocation_city", S), ("geolocation_state", S)),
    "translation": _schema(("product_category_name", S), ("product_category_name_english", S)),
}
TIMESTAMPS = {
    "orders": ["order_purchase_timestamp", "order_approved_at", "order_delivered_carrier_date",
               "order_delivered_customer_date", "order_estimated_delivery_date"],
    "items": ["shipping_limit_date"],
    "reviews": ["review_creation_date", "review_answer_timestamp"],
}
MONEY = {"items": ["price", "freight_value"], "payments": ["payment_value"]}
# spelling fixes applied when the star is loaded
RENAMES = {"products": {"product_name_lenght": "product_name_length",
                        "product_description_lenght": "product_description_length"}}


def parse_ts(col: str):
    """text -> TIMESTAMP_NTZ; bad values -> NULL."""
    return F.try_to_timestamp(F.col(col), F.lit(TS_FORMAT)).cast("timestamp_ntz")


#: Tables with free text, whose quoted fields hold line breaks; only their files cannot be split.
FREE_TEXT = {"reviews"}


def read_csv(spark: SparkSession, path: str, schema: StructType, multi_line: bool = False) -> DataFrame:
    return (spark.read.schema(schema).option("header", True).option("multiLine", multi_line)
            .option("escape", '"').option("mode", "PERMISSIVE").csv(path))


def read_table(spark: SparkSession, raw_dir: str, name: str, files: dict | None = None) -> DataFrame:
    df = read_csv(spark, os.path.join(raw_dir, (files or RAW_FILES)[name]), RAW_SCHEMAS[name], name in FREE_TEXT)
    df = df.withColumns({c: parse_ts(c) for c in TIMESTAMPS.get(name, [])})
    df = df.withColumns({c: money(F.col(c).try_cast("decimal(12,2)")) for c in MONEY.get(name, [])})
    if name in RENAMES:
        df = df.withColumnsRenamed(RENAMES[name])
    return df


def read_raw(spark: SparkSession, raw_dir: str, files: dict | None = None) -> Raw:
    """The nine raw files as a `Raw` bundle (same shape as the lens)."""
    return Raw(**{name: read_table(spark, raw_dir, name, files) for name in RAW_FILES})


# ------------------------------------------------------------ sinks
#: Cells keep their white space.
KEEP_SPACE = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def as_text(df: DataFrame) -> DataFrame:
    """Every cell as the text that the file holds."""
    return df.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in df.columns])


def content(df: DataFrame) -> list:
    """Aggregates that tell what a table of text cells holds, whatever its
    order: rows and a digest, the sum of a 64-bit hash of every row.  A missing
    cell counts as empty text, as a CSV file does not tell them apart."""
    cells = [F.coalesce(F.col(f"`{c}`"), F.lit("")) for c in df.columns]
    return [F.count(F.lit(1)).alias("rows"),
            F.coalesce(F.sum(F.xxhash64(*cells).cast("decimal(38,0)")), F.lit(0)).cast("string").alias("digest")]


def write_csv(df: DataFrame, path: str) -> None:
    """Headered CSV, idempotent overwrite, written in parallel."""
    df.write.mode("overwrite").options(header=True, escape='"', **KEEP_SPACE).csv(path)


def write_csv_bom(df: DataFrame, path: str) -> None:
    """One UTF-8 file with a BOM and every field quoted, for the small
    dashboard extracts (bounded by design: aggregated views).

    Lines are rendered with `to_csv` on the executors.  Each line keeps the
    position it had in `df` (`monotonically_increasing_id` follows the
    partition order of a sorted frame); the header gets -1, and the single
    output partition is sorted by that key."""
    spark = df.sparkSession
    opts = {"quoteAll": "true", "escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
    header = spark.range(1).select(F.lit("\ufeff" + ",".join(f'"{c}"' for c in df.columns)).alias("value"),
                                   F.lit(-1).cast("long").alias("k"))
    body = df.select(F.to_csv(F.struct(*[F.col(c) for c in df.columns]), opts).alias("value"),
                     F.monotonically_increasing_id().alias("k"))
    lines = header.unionByName(body).coalesce(1).sortWithinPartitions("k").select("value")
    lines.write.mode("overwrite").text(path)


def observed_write(df: DataFrame, path: str, bom: bool = False) -> dict:
    """Write an extract and report its shape and content digest, both
    observed in the write itself: the extract is computed once."""
    text = as_text(df)
    seen = Observation()
    rows, digest = content(text)
    (write_csv_bom if bom else write_csv)(text.observe(seen, rows, digest), path)
    return {"rows": seen.get["rows"], "cols": len(df.columns), "digest": seen.get["digest"]}


def read_back_check(spark: SparkSession, path: str, expected: dict, expected_cols: list[str], multi_line: bool = False) -> dict:
    """Re-read a written extract and compare columns, rows and content with
    what ``observed_write`` saw.  Cells with line breaks need ``multi_line``,
    which reads each file in one task; other files are split."""
    back = (spark.read.options(header=True, multiLine=multi_line, escape='"', encoding="UTF-8", **KEEP_SPACE).csv(path))
    cols = [c.lstrip("\ufeff") for c in back.columns]
    got = back.toDF(*cols)
    got = got.agg(*content(got)).first()
    ok = cols == list(expected_cols) and (got["rows"], got["digest"]) == (expected["rows"], expected["digest"])
    return {"path": path, "rows": got["rows"], "cols": cols, "digest": got["digest"], "ok": ok}
