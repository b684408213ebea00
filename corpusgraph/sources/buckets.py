"""Stored tables in hash buckets: changes rewrite the buckets they touch, deletes are merged when the table is read.

``<path>/manifest/<version>`` lists, for each bucket, the version that wrote its rows, the versions with deletes that still have
to be applied, and the last batch of each writer. A version counts once its manifest is complete, so a change that is broken off
leaves the table as it was, and a batch that is sent again changes nothing. One writer at a time; readers need no lock.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusgraph.session import materialize

VERSION, BUCKET = "at_version", "in_bucket"
_DELETES = f"column_name string, value string, {VERSION} int"


@dataclass(frozen=True)
class Manifest:
    version: int = -1
    buckets: dict[int, int] = field(default_factory=dict)  # bucket: version that wrote it
    deletes: tuple[int, ...] = ()
    batches: dict[str, int] = field(default_factory=dict)  # last batch of each writer


class BucketTable:
    """A stored table of ``schema``, dealt by the hash of ``key``. The driver holds one entry for each bucket."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, key: str, buckets: int = 64):
        self.spark, self.path, self.key, self.n = spark, path.rstrip("/"), key, buckets
        self.schema = schema
        self._stored = T.StructType([*schema.fields, T.StructField(VERSION, T.IntegerType()), T.StructField(BUCKET, T.IntegerType())])

    # ---- versions ----

    def _names(self, folder: str) -> list[str]:
        root = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{folder}")
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return [s.getPath().getName() for s in fs.listStatus(root)] if fs.exists(root) else []

    def versions(self) -> list[int]:
        """Versions whose manifest is complete."""
        return [v for v in sorted(int(n) for n in self._names("manifest") if n.isdigit())
                if "_SUCCESS" in self._names(f"manifest/{v:08d}")]

    def manifest(self, version: int | None = None) -> Manifest:
        if version is None:
            known = self.versions()
            if not known:
                return Manifest()
            version = known[-1]
        text = self.spark.read.text(f"{self.path}/manifest/{version:08d}").first()["value"]
        found = json.loads(text)
        return Manifest(found["version"], {int(b): v for b, v in found["buckets"].items()}, tuple(found["deletes"]), found["batches"])

    def _commit(self, new: Manifest) -> None:
        row = self.spark.createDataFrame([(json.dumps(asdict(new)),)], "value string")
        row.coalesce(1).write.mode("overwrite").text(f"{self.path}/manifest/{new.version:08d}")

    def _next(self, old: Manifest, writer: str, batch: int | None, **changes) -> Manifest:
        batches = old.batches if batch is None else {**old.batches, writer: batch}
        return replace(old, version=old.version + 1, batches=batches, **changes)

    # ---- reading ----

    def _rows(self, manifest: Manifest, buckets: list[int] | None = None) -> DataFrame:
        """Stored rows of some buckets, deletes not applied."""
        paths = [f"{self.path}/data/{VERSION}={v}/{BUCKET}={b}" for b, v in manifest.buckets.items()
                 if buckets is None or b in buckets]
        if not paths:
            return self.spark.createDataFrame([], self._stored)
        return self.spark.read.schema(self._stored).option("basePath", f"{self.path}/data").parquet(*paths)

    def _gone(self, manifest: Manifest) -> DataFrame:
        """column_name, value and the newest version that deleted it."""
        if not manifest.deletes:
            return self.spark.createDataFrame([], _DELETES)
        paths = [f"{self.path}/deletes/{VERSION}={v}" for v in manifest.deletes]
        return (self.spark.read.schema(_DELETES).option("basePath", f"{self.path}/deletes").parquet(*paths)
                .groupBy("column_name", "value").agg(F.max(VERSION).alias("gone_at")))

    def _columns(self, manifest: Manifest) -> list[str]:
        if not manifest.deletes:
            return []
        return sorted(r[0] for r in self._gone(manifest).select("column_name").distinct().collect())

    def _live(self, manifest: Manifest, rows: DataFrame) -> DataFrame:
        for c in self._columns(manifest):
            gone = self._gone(manifest).filter(F.col("column_name") == c).select("value", "gone_at")
            rows = rows.join(gone, (F.col(c).cast("string") == F.col("value")) & (F.col(VERSION) < F.col("gone_at")), "left_anti")
        return rows

    def read(self, version: int | None = None) -> DataFrame:
        """The table, or what it was at an earlier version."""
        manifest = self.manifest(version)
        return self._live(manifest, self._rows(manifest)).select(*self.schema.names)

    # ---- writing ----

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.n)).cast("int")

    def _write(self, version: int, rows: DataFrame, buckets: list[int], old: Manifest) -> dict[int, int]:
        """Rewrite ``buckets`` with ``rows``; large ones become several files."""
        rows.select(*self.schema.names, BUCKET).hint("rebalance", BUCKET).write.mode("overwrite").partitionBy(BUCKET).parquet(
            f"{self.path}/data/{VERSION}={version}")
        written = [int(n.split("=")[1]) for n in self._names(f"data/{VERSION}={version}") if n.startswith(BUCKET)]
        return {b: v for b, v in old.buckets.items() if b not in buckets} | dict.fromkeys(written, version)

    def merge(self, new: DataFrame, on: list[str], gone: dict[str, DataFrame] | None = None, writer: str = "",
              batch: int | None = None) -> Manifest:
        """Rows that share a value of a column of ``on`` with ``new`` go, those with a value in ``gone`` too; then ``new`` comes.

        Only buckets that gain or lose rows are rewritten; to find them, one column of the others is read. A ``batch`` that is
        not after the writer's last one is taken as applied. A null shares no value.
        """
        old = self.manifest()
        if batch is not None and batch <= old.batches.get(writer, -1):
            return old
        new = materialize(new.select(*self.schema.names), "incoming")
        leaving = [(c, new.select(c).distinct()) for c in on] + [(c, v.select(c).distinct()) for c, v in (gone or {}).items()]
        touched = {r[0] for r in new.select(self._bucket().alias("b")).distinct().collect()}
        rows = self._live(old, self._rows(old))
        for c, values in leaving:
            if c == self.key:
                where = values.filter(F.col(c).isNotNull()).select(self._bucket().alias(BUCKET))
            else:
                where = rows.select(c, BUCKET).join(values, c, "left_semi")
            touched |= {r[0] for r in where.select(BUCKET).distinct().collect()}
        buckets = sorted(touched)
        kept = self._live(old, self._rows(old, buckets))
        for c, values in leaving:
            kept = kept.join(values, c, "left_anti")
        out = kept.select(*self.schema.names, BUCKET).unionByName(new.withColumn(BUCKET, self._bucket()))
        manifest = self._next(old, writer, batch)
        if buckets:
            manifest = replace(manifest, buckets=self._write(manifest.version, out, buckets, old))
        self._commit(manifest)
        return manifest

    def delete(self, values: DataFrame, columns: list[str], writer: str = "", batch: int | None = None) -> Manifest:
        """Rows with one of ``values`` (its first column) in any of ``columns`` go; no data file is rewritten."""
        old = self.manifest()
        if batch is not None and batch <= old.batches.get(writer, -1):
            return old
        new = self._next(old, writer, batch, deletes=(*old.deletes, old.version + 1))
        name = F.explode(F.array(*map(F.lit, columns))).alias("column_name")
        (values.select(F.col(values.columns[0]).cast("string").alias("value")).filter("value is not null").distinct()
         .select(name, "value").write.mode("overwrite").parquet(f"{self.path}/deletes/{VERSION}={new.version}"))
        self._commit(new)
        return new

    def compact(self) -> Manifest:
        """Apply all deletes: buckets that hold deleted rows are rewritten, the others stay as they are."""
        old = self.manifest()
        if not old.deletes:
            return old
        hit: set[int] = set()
        for c in self._columns(old):
            gone = self._gone(old).filter(F.col("column_name") == c).select("value", "gone_at")
            rows = self._rows(old).select(c, VERSION, BUCKET)
            found = rows.join(gone, (F.col(c).cast("string") == F.col("value")) & (F.col(VERSION) < F.col("gone_at")), "left_semi")
            hit |= {r[0] for r in found.select(BUCKET).distinct().collect()}
        buckets = sorted(hit)
        new = self._next(old, "", None, deletes=())
        if buckets:
            new = replace(new, buckets=self._write(new.version, self._live(old, self._rows(old, buckets)), buckets, old))
        self._commit(new)
        return new


def create(df: DataFrame, path: str, key: str, buckets: int = 64) -> BucketTable:
    """A stored table with the rows of ``df``; an existing one at ``path`` gets a new version that has only these."""
    table = BucketTable(df.sparkSession, path, T.StructType([T.StructField(f.name, f.dataType) for f in df.schema]), key, buckets)
    new = table._next(table.manifest(), "", None, deletes=())
    rows = df.withColumn(BUCKET, table._bucket())
    table._commit(replace(new, buckets=table._write(new.version, rows, list(range(buckets)), new)))
    return table
