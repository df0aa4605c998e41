"""CSV sources and sinks: schema read with bad timestamps, BOM extract, read-back."""

import codecs

from pyspark.sql import functions as F

from mercato.sources import raw_io


def test_bom_extract_roundtrip(spark, tmp_path):
    df = spark.createDataFrame([(1, 'say "hi"', 2.5), (2, "a,b", None)], "id int, txt string, v double").orderBy("id")
    path = str(tmp_path / "x")
    stats = raw_io.observed_write(df, path, bom=True)
    assert (stats["rows"], stats["cols"]) == (2, 3)
    files = [p for p in (tmp_path / "x").iterdir() if p.name.startswith("part-")]
    assert len(files) == 1
    raw = files[0].read_bytes()
    assert raw.startswith(codecs.BOM_UTF8 + b'"id","txt","v"')
    assert b'"say ""hi"""' in raw
    assert raw_io.read_back_check(spark, path, stats, ["id", "txt", "v"])["ok"]


def _extract(spark):
    return spark.range(2000).selectExpr("id", "concat('n', id % 7, ' ') as name", "if(id % 5 = 0, null, id / 4) as v",
                                        "timestamp_ntz'2020-01-01 00:00:00' + make_dt_interval(0, 0, 0, id) as t")


def test_extract_is_computed_once_and_its_content_checked(spark, tmp_path):
    path, df = str(tmp_path / "x"), _extract(spark)
    spark.sparkContext.setJobGroup("one-write", "one-write")
    try:
        stats = raw_io.observed_write(df, path)
        jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("one-write")
    finally:
        spark.sparkContext._jsc.clearJobGroup()
    assert len(jobs) == 1 and stats["rows"] == 2000
    assert raw_io.read_back_check(spark, path, stats, df.columns)["ok"]
    # the same rows in another order and partitioning are the same content
    raw_io.write_csv(raw_io.as_text(df.repartition(5)), path)
    assert raw_io.read_back_check(spark, path, stats, df.columns)["ok"]
    # two cells of one column change places: rows, columns and every column's values stay
    swapped = df.withColumn("name", F.expr("case id when 1 then 'n2 ' when 2 then 'n1 ' else name end"))
    raw_io.write_csv(raw_io.as_text(swapped), path)
    back = raw_io.read_back_check(spark, path, stats, df.columns)
    assert back["rows"] == stats["rows"] and not back["ok"]


def test_missing_and_repeated_rows_and_other_columns_are_found(spark, tmp_path):
    path, df = str(tmp_path / "x"), _extract(spark)
    stats = raw_io.observed_write(df, path)
    for other in (df.where("id <> 5"), df.where("id <> 5").unionByName(df.where("id = 6")), df.withColumnRenamed("v", "w")):
        raw_io.write_csv(raw_io.as_text(other), path)
        assert not raw_io.read_back_check(spark, path, stats, df.columns)["ok"]
    empty = raw_io.observed_write(df.limit(0), path)
    assert empty["rows"] == 0


def test_read_raw_orders_bad_timestamp_is_null(spark, tmp_path):
    p = tmp_path / "orders.csv"
    p.write_text("order_id,customer_id,order_status,order_purchase_timestamp,order_approved_at,"
                 "order_delivered_carrier_date,order_delivered_customer_date,order_estimated_delivery_date\n"
                 "o1,c1,delivered,2017-10-02 10:56:33,not a date,,2017-10-10 21:25:13,2017-10-18 00:00:00\n")
    df = raw_io.read_table(spark, str(tmp_path), "orders")
    r = df.first()
    assert r.order_approved_at is None and r.order_purchase_timestamp.year == 2017
    assert dict(df.dtypes)["order_purchase_timestamp"] == "timestamp_ntz"


def test_products_spelling_fix(spark, tmp_path):
    (tmp_path / "products.csv").write_text(
        "product_id,product_category_name,product_name_lenght,product_description_lenght,product_photos_qty,"
        "product_weight_g,product_length_cm,product_height_cm,product_width_cm\np1,x,10,20,1,100,10,10,10\n")
    df = raw_io.read_table(spark, str(tmp_path), "products")
    assert "product_name_length" in df.columns and "product_description_length" in df.columns


def test_star_save_load_roundtrip(spark, tmp_path):
    from mercato.params import FIXTURE_PARAMS as P
    from mercato.plans import views as V
    from mercato.plans.registry import star_for
    from mercato.sources.star import Star

    s = star_for(spark, "/root/testdata/sf0.001")
    s.save(str(tmp_path / "star"))
    loaded = Star.load(spark, str(tmp_path / "star"))
    for name, df in s.tables().items():
        assert loaded.tables()[name].count() == df.count(), name
    a = sorted(tuple(r) for r in V.category_sla(s, P).collect())
    b = sorted(tuple(r) for r in V.category_sla(loaded, P).collect())
    assert a == b
    # a month's orders read that month's folder only, and a folder is written by few tasks
    import datetime as dt

    import re

    month = loaded.orders_between(dt.date(2000, 1, 1), dt.date(2000, 1, 20))
    plan = month._jdf.queryExecution().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*purchase_month", plan)
    assert month.count() == s.orders_between(dt.date(2000, 1, 1), dt.date(2000, 1, 20)).count() > 0
    folders = list((tmp_path / "star" / "fact_orders").glob("purchase_month=*"))
    files = list((tmp_path / "star" / "fact_orders").glob("purchase_month=*/part-*"))
    assert len(files) <= 2 * len(folders)


def test_row_counts_of_a_stored_star_show_a_loss(spark):
    from mercato.plans.quality import row_count_report
    from mercato.plans.registry import star_for
    from mercato.sources.star import stored

    s = star_for(spark, "/root/testdata/sf0.001")
    loaded = stored(s)
    assert {r.status for r in row_count_report(s, loaded).collect()} == {"OK"}
    loaded.bridge_reviews = loaded.bridge_reviews.limit(3)
    assert {r.table_name: r.status for r in row_count_report(s, loaded).collect()}["bridge_reviews"] == "MISMATCH"


def test_sql_over_registered_views(spark):
    from mercato.params import FIXTURE_PARAMS as P
    from mercato.plans import views as V
    from mercato.plans.registry import star_for

    s = star_for(spark, "/root/testdata/sf0.001")
    V.register_views(s, P, prefix="t_")
    got = spark.sql("select count(*) as n from t_v_category_sla where total_orders >= 30").first().n
    assert got == V.category_sla(s, P).filter("total_orders >= 30").count()
    assert spark.sql("select count(*) from t_fact_orders").first()[0] == s.fact_orders.count()


def test_export_extracts_read_back(spark, tmp_path):
    from mercato.params import FIXTURE_PARAMS as P
    from mercato.plans.exports import export_extracts
    from mercato.plans.registry import star_for

    s = star_for(spark, "/root/testdata/sf0.001")
    rep = {r.file: r for r in export_extracts(spark, s, P, str(tmp_path)).collect()}
    assert set(rep) == {"rfm_segments", "cohort_retention", "revenue_by_category", "category_sla",
                        "seller_performance", "cancellation_analysis", "unified_tableau"}
    assert all(r.read_back_ok for r in rep.values())
    part = next(p for p in (tmp_path / "tableau" / "category_sla").iterdir() if p.name.startswith("part-"))
    assert part.read_bytes().startswith(codecs.BOM_UTF8 + b'"product_category_name"')


def test_bucketed_star_joins_without_exchange(spark, tmp_path):
    from mercato.plans.registry import star_for
    from mercato.sources.star import Star

    s = star_for(spark, "/root/testdata/sf0.001")
    s.save_tables(spark, "bucket_test", 4, location=str(tmp_path / "db"))
    t = Star.load_tables(spark, "bucket_test")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        j = t.fact_order_items.join(t.fact_orders, "order_id")
        plan = j._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
        assert j.count() == s.fact_order_items.join(s.fact_orders, "order_id").count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_raw_csv_path_matches_lens(spark, tmp_path):
    """Production input path: raw CSV files -> read_raw -> star -> views give
    the same figures as the lens-built star."""
    from mercato.params import FIXTURE_PARAMS as P
    from mercato.plans import views as V
    from mercato.sources import lens
    from mercato.sources.star import build

    raw = lens.load(spark, "/root/testdata/sf0.001")
    for name, schema in raw_io.RAW_SCHEMAS.items():
        df = getattr(raw, name)
        cols = []
        for f in schema.fields:
            src = f.name.replace("_lenght", "_length")
            if src in df.columns:
                c = F.col(src)
                if "timestamp" in str(df.schema[src].dataType):
                    c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
                cols.append(c.cast("string").alias(f.name))
            else:
                cols.append(F.lit(None).cast("string").alias(f.name))
        raw_io.write_csv(df.select(cols).coalesce(1), str(tmp_path / "csv" / name))
    files = {n: f"{n}/*.csv" for n in raw_io.RAW_FILES}
    from_csv = build(raw_io.read_raw(spark, str(tmp_path / "csv"), files), P)
    from_lens = build(raw, P)

    def figures(s):
        sla = V.category_sla(s, P).select("product_category_name", "total_orders", "late_rate_pct",
                                          "p90_days_to_deliver", "sla_tier")
        return sorted(tuple(r) for r in sla.collect())

    assert figures(from_csv) == figures(from_lens)
    rev = lambda s: V.revenue_by_category(s, P).agg(F.sum("total_revenue")).first()[0]
    assert abs(rev(from_csv) - rev(from_lens)) < 1e-6
    assert from_csv.fact_orders.filter("is_late").count() == from_lens.fact_orders.filter("is_late").count()
