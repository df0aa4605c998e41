"""Incremental load of the star: batches, each of which counts once.

A batch is a part of the star (a day's export, a chunk of a table) under an
id that its owner chooses.  Its rows are written to a folder of their own
below every table and become visible by one step, when the manifest of the
batch is published (see mercato.ml.store).  So a batch that is loaded again
changes nothing and reads nothing, of two writers of one batch one counts,
and what a lost driver wrote is never read.  A batch whose rows were wrong is
taken back and loaded anew.  The row counts of the manifest are observed in
the writes; ``check`` compares them with the stored rows.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from mercato.ml.store import Manifest, ModelStore, folder_of, now, table_version
from mercato.session import ensure_checkpoint_dir, run_concurrently
from mercato.sources.star import MONTH, Star, purchase_month

#: Partition column of every loaded table.
BATCH = "load_batch"


class StarLoad:
    """The load folder ``root``: ``tables/<table>/load_batch=<run>`` and the manifests."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.store = ModelStore(spark, self.root)

    @staticmethod
    def exists(spark: SparkSession, root: str) -> bool:
        p, fs = folder_of(spark, f"{root.rstrip('/')}/published")
        return fs.exists(p)

    def _folder(self, table: str, run: str) -> str:
        return f"{self.root}/tables/{table}/{BATCH}={run}"

    def _key(self, batch: str) -> str:
        return ModelStore.key("batch", batch, {})

    def _remove(self, tables, run: str) -> None:
        for t in tables:
            p, fs = folder_of(self.spark, self._folder(t, run))
            fs.delete(p, True)

    def batches(self) -> list[Manifest]:
        """Manifests of the loaded batches, oldest first; ``tag`` is the batch's id."""
        return self.store.manifests()

    def load(self, batch: str, s: Star, parallel: int = 8) -> Manifest:
        """Load the tables of ``s`` as ``batch``; the known manifest if it is loaded already."""
        key = self._key(batch)
        if (known := self.store.find(key)) is not None:
            return known
        run, tables = uuid.uuid4().hex, s.tables()

        def write(item):
            name, df = item
            seen, schema = Observation(), df.schema
            df = df.observe(seen, F.count(F.lit(1)).alias("rows"))
            if name == "fact_orders":
                df = df.withColumn(MONTH, purchase_month()).hint("rebalance", MONTH)
                schema = df.schema
                df.write.partitionBy(MONTH).parquet(self._folder(name, run))
            else:
                df.write.parquet(self._folder(name, run))
            return name, int(seen.get.get("rows") or 0), schema.json()

        done = run_concurrently(self.spark, [lambda it=it: write(it) for it in tables.items()], max_workers=parallel)
        m = Manifest(key, run, now(), batch, {name: str(n) for name, n, _ in done},
                     json.dumps({name: schema for name, _, schema in done}))
        counts = self.store.publish(m)
        if counts.run != run:
            self._remove(tables, run)
        return counts

    def retract(self, batch: str) -> bool:
        """Take a batch back: first its manifest, so no reader sees half of it, then its rows."""
        known = self.store.find(self._key(batch))
        if known is None:
            return False
        self.store.withdraw(known.key)
        self._remove(known.inputs, known.run)
        return True

    def _read(self, table: str, batches: list[Manifest]) -> DataFrame:
        fields = json.loads(json.loads(batches[-1].parameters)[table])
        schema = StructType([*StructType.fromJson(fields).fields, StructField(BATCH, StringType())])
        return (self.spark.read.schema(schema).option("basePath", f"{self.root}/tables/{table}")
                .parquet(*[self._folder(table, m.run) for m in batches]))

    def _chosen(self, batches: list[str] | None) -> list[Manifest]:
        got = [m for m in self.batches() if batches is None or m.tag in batches]
        if not got or (batches is not None and len(got) < len(set(batches))):
            raise FileNotFoundError(f"batches of {self.root}: {[m.tag for m in got]}, asked for {batches}")
        return got

    def star(self, batches: list[str] | None = None) -> Star:
        """The star of all loaded batches, or of those named."""
        got = self._chosen(batches)
        return Star(**{t: self._read(t, got).drop(BATCH) for t in got[-1].inputs})

    def check(self, batches: list[str] | None = None) -> DataFrame:
        """(batch, table_name, expected, loaded, status): rows by manifest and as stored."""
        got = self._chosen(batches)
        parts = None
        for t in got[-1].inputs:
            n = self._read(t, got).groupBy(BATCH).agg(F.count(F.lit(1)).alias("loaded")).withColumn("table_name", F.lit(t))
            parts = n if parts is None else parts.unionByName(n)
        expected = self.spark.createDataFrame(
            [(m.tag, m.run, t, int(n)) for m in got for t, n in m.inputs.items()],
            f"batch string, {BATCH} string, table_name string, expected long")
        loaded = F.coalesce("loaded", F.lit(0)).cast("long")
        return expected.join(parts, [BATCH, "table_name"], "left").select(
            "batch", "table_name", "expected", loaded.alias("loaded"),
            F.when(F.col("expected") == loaded, "OK").otherwise("MISMATCH").alias("status"))

    def repeated_keys(self, table: str, keys: list[str]) -> DataFrame:
        """Keys of ``table`` that more than one batch holds, with the number of batches and rows."""
        x = self._read(table, self._chosen(None))
        per = x.groupBy(*keys, BATCH).agg(F.count(F.lit(1)).alias("n"))
        return per.groupBy(*keys).agg(F.count(F.lit(1)).alias("batches"), F.sum("n").alias("rows")).where("batches > 1")


def loaded_once(s: Star) -> Star:
    """``s`` in the load folder of the shared checkpoint folder, written only if these versions of its
    tables are not there yet."""
    spark = s.fact_orders.sparkSession
    load = StarLoad(spark, f"{ensure_checkpoint_dir(spark).rstrip('/')}/star")
    batch = ModelStore.key("star", "", {name: table_version(df) for name, df in s.tables().items()})
    load.load(batch, s)
    return load.star([batch])
