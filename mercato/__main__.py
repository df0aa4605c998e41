"""Command line: list and run the registered jobs, build the star, export extracts.

    python -m mercato list
    python -m mercato run category_sla --sf-dir /root/testdata/sf0.01 [--out out/ --format parquet|csv]
    python -m mercato build-star --raw-dir /data/raw --out /warehouse/star          (raw CSV export)
    python -m mercato build-star --sf-dir /root/testdata/sf0.1 --out /warehouse/star (test tables)
    python -m mercato train --star /warehouse/star --model /models/late            (fit and save)
    python -m mercato score --star /warehouse/star --model /models/late --out /scores
    python -m mercato export --star /warehouse/star --out /exports

On a cluster the session comes from spark-submit; locally a local session is
created.  Production constants are the `Params` defaults; `--fixtures` uses
the values re-based onto the driver's test tables.
"""

from __future__ import annotations

import argparse
import sys


def _session():
    import os

    from pyspark.sql import SparkSession

    from mercato.session import configure, ensure_checkpoint_dir, local_session

    if os.environ.get("PYSPARK_GATEWAY_PORT") or SparkSession.getActiveSession() is not None:
        spark = configure(SparkSession.builder.getOrCreate())  # launched by spark-submit / notebook
    else:
        spark = local_session()
    ensure_checkpoint_dir(spark)
    return spark


def main(argv=None) -> int:
    ap = argparse.ArgumentParser(prog="mercato")
    sub = ap.add_subparsers(dest="cmd", required=True)
    sub.add_parser("list")
    r = sub.add_parser("run")
    r.add_argument("key")
    r.add_argument("--sf-dir")
    r.add_argument("--star")
    r.add_argument("--raw-dir", help="raw CSV export; needed with --star for the data-quality jobs")
    r.add_argument("--out")
    r.add_argument("--format", default="parquet", choices=["parquet", "csv"])
    r.add_argument("--fixtures", action="store_true")
    b = sub.add_parser("build-star")
    b.add_argument("--raw-dir")
    b.add_argument("--sf-dir")
    b.add_argument("--out", required=True)
    b.add_argument("--fixtures", action="store_true")
    t = sub.add_parser("train")
    t.add_argument("--star", required=True)
    t.add_argument("--model", required=True)
    t.add_argument("--fixtures", action="store_true")
    sc = sub.add_parser("score")
    sc.add_argument("--star", required=True)
    sc.add_argument("--model", required=True)
    sc.add_argument("--out", required=True)
    sc.add_argument("--fixtures", action="store_true")
    e = sub.add_parser("export")
    e.add_argument("--star", required=True)
    e.add_argument("--out", required=True)
    e.add_argument("--fixtures", action="store_true")
    a = ap.parse_args(argv)

    from mercato.params import FIXTURE_PARAMS, Params
    from mercato.plans import catalog  # noqa: F401
    from mercato.plans.registry import REGISTRY

    p = FIXTURE_PARAMS if getattr(a, "fixtures", False) else Params()
    if a.cmd == "list":
        print("\n".join(sorted(REGISTRY)))
        return 0

    from mercato.functions.interchange import portable
    from mercato.sources import lens, raw_io
    from mercato.sources.star import Star, build

    spark = _session()
    if a.cmd == "build-star":
        raw = raw_io.read_raw(spark, a.raw_dir) if a.raw_dir else lens.load(spark, a.sf_dir)
        build(raw, p).save(a.out)
        return 0
    if a.cmd == "export":
        from mercato.plans.exports import export_extracts

        export_extracts(spark, Star.load(spark, a.star), p, a.out).show(truncate=False)
        return 0
    if a.cmd in ("train", "score"):
        from mercato.ml import jobs

        star = Star.load(spark, a.star)
        if a.cmd == "train":
            jobs.training(star, p, path=a.model)
            jobs.forest_report(star, p, path=a.model).show(truncate=False)
        else:
            jobs.score_saved(star, p, a.model).write.mode("overwrite").parquet(a.out)
        return 0
    # run
    if a.star:
        star = Star.load(spark, a.star)
        star.raw = raw_io.read_raw(spark, a.raw_dir) if a.raw_dir else None
    else:
        raw = lens.load(spark, a.sf_dir)
        star = build(raw, p)
    df = portable(REGISTRY[a.key](star, p))
    if a.out:
        w = df.write.mode("overwrite")
        (w.option("header", True).csv(a.out) if a.format == "csv" else w.parquet(a.out))
    else:
        df.show(50, truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main())
