"""A keyed store in Parquet, in buckets by the key's hash: a change writes the buckets that it touches and leaves the others' files alone.

`data/v=<number>/k_bucket=<bucket>` holds what change number wrote of a bucket; `m=<number>` is that version's list of the folders that are in force, a row for each. The newest list with a
success mark counts, so readers keep seeing the last version until the next one is whole; the version before it is kept for its readers, and folders that
neither names are deleted. Changes are joins and unions over DataFrames, so stores may be larger than one machine; the driver holds the list only, whose length grows with the number of
buckets and of insertions since a bucket was last rewritten. One writer at a time is assumed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from fernglass.operators import state
from fernglass.operators.components import numbered

BUCKETS = 64
_LIST = "k_bucket int, folder string, buckets int"


class Store:
    def __init__(self, spark: SparkSession, path: str, schema: str, key: str, buckets: int = BUCKETS):
        """`buckets` counts for a store that is written first; later the store's own number does."""
        self.spark, self.path, self.key, self._new = spark, path.rstrip("/"), key, buckets
        self.schema = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)

    def _files(self):
        jvm = self.spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        return jvm, root, root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _versions(self) -> list[int]:
        jvm, root, fs = self._files()
        if not fs.exists(root):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(root)]
        return sorted(int(n[2:]) for n in names if n.startswith("m=") and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{self.path}/{n}/_SUCCESS")))

    def version(self) -> int:
        """The newest whole version; 0 for a store that was never written."""
        return max(self._versions(), default=0)

    def _listed(self, version: int) -> list:
        return self.spark.read.schema(_LIST).json(f"{self.path}/m={version}").where("folder is not null").collect() if version else []

    def _count(self) -> int:
        rows = self._all(self.version())
        return rows[0].buckets if rows else self._new

    def _all(self, version: int) -> list:
        return self.spark.read.schema(_LIST).json(f"{self.path}/m={version}").collect() if version else []

    def _bucket(self, key, buckets: int):
        return F.pmod(F.xxhash64(key.cast(self.schema[self.key].dataType)), F.lit(buckets)).cast("int")

    def _rows(self, listed: list) -> DataFrame:
        if not listed:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*(f"{self.path}/{r.folder}" for r in listed))

    def read(self) -> DataFrame:
        """All rows; fields that older files lack are null."""
        return self._rows(self._listed(self.version()))

    def get(self, key) -> DataFrame:
        """The rows of a key, out of its bucket's files."""
        at = self.spark.range(1).select(self._bucket(F.lit(key), self._count())).first()[0]
        return self._rows([r for r in self._listed(self.version()) if r.k_bucket == at]).where(F.col(self.key) == key)

    def _touched(self, keys: DataFrame, buckets: int) -> set[int]:
        return {r[0] for r in keys.select(self._bucket(F.col(self.key), buckets)).distinct().collect()}

    def _commit(self, rows: DataFrame, replaced: set[int], buckets: int) -> None:
        """Write rows as a version's folders and the list in which they stand for the replaced buckets' ones, or beside the others'."""
        last = self.version()
        new, folder = last + 1, f"data/v={last + 1}"
        marked = rows.select(*self.schema.names).withColumn("k_bucket", self._bucket(F.col(self.key), buckets))
        marked.repartition("k_bucket").write.mode("overwrite").partitionBy("k_bucket").parquet(f"{self.path}/{folder}")
        jvm, root, fs = self._files()
        written = [s.getPath().getName() for s in fs.listStatus(jvm.org.apache.hadoop.fs.Path(f"{self.path}/{folder}"))]
        listed = [(r.k_bucket, r.folder, buckets) for r in self._listed(last) if r.k_bucket not in replaced]
        listed += [(int(n.removeprefix("k_bucket=")), f"{folder}/{n}", buckets) for n in written if n.startswith("k_bucket=")]
        self.spark.createDataFrame([*listed, (None, None, buckets)], _LIST).coalesce(1).write.mode("overwrite").json(f"{self.path}/m={new}")
        for old in self._versions():
            if old < last:  # readers of the last version may still be at work; older ones are not
                fs.delete(jvm.org.apache.hadoop.fs.Path(f"{self.path}/m={old}"), True)
        used = {r.folder for v in (last, new) for r in self._listed(v)}
        for version in fs.listStatus(jvm.org.apache.hadoop.fs.Path(f"{self.path}/data")):
            for status in fs.listStatus(version.getPath()):
                name = f"data/{version.getPath().getName()}/{status.getPath().getName()}"
                if status.isDirectory() and name not in used:
                    fs.delete(status.getPath(), True)

    def put(self, rows: DataFrame) -> None:
        """Rows replace those of their keys. Of rows with one key one is put."""
        buckets = self._count()
        new = rows.select(*self.schema.names).dropDuplicates([self.key])
        touched = self._touched(new, buckets)
        old = self._rows([r for r in self._listed(self.version()) if r.k_bucket in touched])
        self._commit(state.upserted(old, new, self.key), touched, buckets)

    def insert(self, rows: DataFrame) -> None:
        """Rows get ids from the largest id plus 1 on, in the order of their columns. Nothing is rewritten: they stand beside what is there."""
        others = tuple(c for c in self.schema.names if c != self.key)
        first = state.next_id(self.read(), self.key).first()[0]
        new = numbered(rows.select(*others), others, "number_", first).withColumn(self.key, F.col("number_").cast(self.schema[self.key].dataType))
        self._commit(new, set(), self._count())

    def delete(self, keys: DataFrame) -> None:
        """Rows of these keys go; only their buckets are rewritten."""
        buckets = self._count()
        touched = self._touched(keys, buckets)
        old = self._rows([r for r in self._listed(self.version()) if r.k_bucket in touched])
        self._commit(state.without(old, keys, self.key), touched, buckets)


def autosave_key(prefix: str, version: int, filename: str) -> str:
    return f"{prefix}{version}_{filename}"


def restored(store: Store, key: str, legacy: DataFrame, body: str = "body") -> DataFrame:
    """The row of a key; where the store has none, the one that an older JSON text holds."""
    found = store.get(key)
    old = legacy.where(F.col(store.key) == key).select(F.from_json(body, store.schema).alias("r")).where("r is not null").select("r.*")
    return found if not found.isEmpty() else old.withColumn(store.key, F.lit(key)).select(*store.schema.names)
