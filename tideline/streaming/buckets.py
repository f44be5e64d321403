"""A table of orders dealt over buckets by id, of which a batch rewrites only those it touches.

A batch is merged with its own buckets and staged first; then Spark's dynamic partition
overwrite puts these buckets in place. A staged batch that is complete is put in place again
after a failure, whatever the buckets held by then, so every step can be repeated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.operators.lines import first_seen
from tideline.operators.orders import change_counts, merge_orders
from tideline.sources.schemas import ORDER

BUCKETS = 256


class BucketedOrders:
    """Orders under root, in `buckets` folders. The number of buckets stays what it was when the table was made."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets

    def bucket(self, id_col: str = "id") -> Column:
        return F.pmod(F.xxhash64(id_col), F.lit(self.buckets)).cast("int")

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def exists(self, name: str) -> bool:
        path, fs = self._path(name)
        return fs.exists(path)

    def _delete(self, name: str) -> None:
        path, fs = self._path(name)
        fs.delete(path, True)

    def read(self) -> DataFrame:
        """All orders; none before the first batch."""
        schema = f"{ORDER}, bucket int"
        if not self.exists("orders"):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.root}/orders")

    def merge(self, batch: DataFrame, name: str) -> dict:
        """Merges refreshed orders; new, changed, and how many buckets were rewritten. A repeated batch (of that name) changes nothing more."""
        staged = f"staged/{name}"
        if not self.exists(f"{staged}/_SUCCESS"):
            self._stage(batch, staged)
        return self._apply(staged)

    def _stage(self, batch: DataFrame, staged: str) -> None:
        rows = first_seen(batch.select(*self.read().drop("bucket").columns)).withColumn("bucket", self.bucket()).persist()
        try:
            # At most as many numbers as there are buckets.
            touched = sorted(r.bucket for r in rows.select("bucket").distinct().collect())
            base = self.read().where(F.col("bucket").isin(touched)) if touched else self.read().limit(0)
            counts = change_counts(base, rows)
            merged = merge_orders(base, rows).withColumns({c: F.lit(None).cast("long") for c in ("new", "changed")})
            # The counts travel with the rows they belong to, so a repeated batch reports the same.
            note = counts.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in base.schema if f.name != "bucket"], F.lit(-1).alias("bucket"), "new", "changed")
            merged = merged.select(note.columns).unionByName(note)
            merged.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/{staged}")
        finally:
            rows.unpersist()

    def _apply(self, staged: str) -> dict:
        rows = self.spark.read.parquet(f"{self.root}/{staged}")
        note = rows.where("bucket = -1").first()
        orders = rows.where("bucket >= 0").drop("new", "changed")
        n = orders.select("bucket").distinct().count()
        if note["new"] or note["changed"]:
            # A bucket is written by one task, or by a few if it is large.
            orders.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{self.root}/orders")
        self._delete(staged)
        return {"new": note["new"], "changed": note["changed"], "buckets": n if note["new"] or note["changed"] else 0}
