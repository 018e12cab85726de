"""Tables kept as partitioned Parquet: merges and deletes that rewrite only the partitions they touch."""

from __future__ import annotations

import uuid
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.predicates import condition
from ..operators.reference_data import upsert


@dataclass(frozen=True)
class Stored:
    """A Parquet table at `path`, in folders by the columns `partition_by`, of which `keys` tell rows apart.

    The partition columns belong to the keys, so that old and new rows of a key lie in one partition. A change is first
    written whole beside the data (in a folder that readers pass over), then takes the place of the partitions it touches.
    If the job is lost between the two, the next change finishes it before it starts. One writer at a time.
    """

    spark: SparkSession
    path: str
    schema: StructType
    keys: tuple[str, ...]
    partition_by: tuple[str, ...]

    def __post_init__(self):
        if not self.partition_by or not set(self.partition_by) <= set(self.keys):
            raise ValueError("the partition columns are some of the keys")

    # ---- files

    def _at(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.path, *parts)))

    def _files(self):
        return self._at().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self) -> list[str]:
        files = self._files()
        return [f.getPath().getName() for f in files.listStatus(self._at())] if files.exists(self._at()) else []

    def exists(self) -> bool:
        return any("=" in n for n in self._names())

    def _load(self, path: str) -> DataFrame:
        return self.spark.read.schema(self.schema).option("basePath", path).parquet(path)

    def read(self) -> DataFrame:
        """All rows; none if nothing was ever written. It changes nothing, so a change that was lost half way shows until resume()."""
        return self._load(self.path).select(*self.schema.names) if self.exists() else self.spark.createDataFrame([], self.schema)

    # ---- changes

    def _folders(self, rows: DataFrame) -> DataFrame:
        """rows of files (_file, once each) with _folder, the part of the path that names the partition."""
        depth = len(self.partition_by)
        path = F.url_decode(F.replace(F.col("_file"), F.lit("+"), F.lit("%2B")))
        return rows.withColumn("_folder", F.regexp_extract(path, rf"((?:[^/]+=[^/]*/){{{depth}}})[^/]*$", 1))

    def _swap(self, pending: str) -> None:
        """The partitions of a pending change, in place of the table's; then the folders that the change left without rows."""
        files = self._files()
        staged = f"{self.path}/{pending}/rows"
        if any("=" in f.getPath().getName() for f in files.listStatus(self._at(pending, "rows"))):
            rows = self.spark.read.schema(self.schema).option("basePath", staged).parquet(staged)
            rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*self.partition_by).parquet(self.path)
        for row in self.spark.read.schema("folder string").parquet(f"{self.path}/{pending}/emptied").toLocalIterator():
            files.delete(self._at(row["folder"].strip("/")), True)
        files.delete(self._at(pending), True)

    def resume(self) -> None:
        """Finish changes that were written whole but not swapped in, and clear away those that were not."""
        for name in self._names():
            if name.startswith("_pending-"):
                if self._files().exists(self._at(name, "emptied", "_SUCCESS")):
                    self._swap(name)
                else:
                    self._files().delete(self._at(name), True)

    def _change(self, rows: DataFrame, emptied: DataFrame | None = None) -> None:
        pending = f"_pending-{uuid.uuid4().hex}"
        spread = rows.select(*[c for c in self.schema.names]).hint("rebalance", *self.partition_by)
        spread.write.partitionBy(*self.partition_by).parquet(f"{self.path}/{pending}/rows")
        none = self.spark.createDataFrame([], "folder string")
        (emptied if emptied is not None else none).write.parquet(f"{self.path}/{pending}/emptied")  # the last to be written
        self._swap(pending)

    def merge(self, new: DataFrame, mode: str = "replace") -> None:
        """Put new rows in by upsert()'s mode: ignore, replace or update. To do so twice is to do so once.

        new has one row a key. Partitions without new rows keep their files. The names of touched partitions pass through
        the driver; they are as many as the folders written.
        """
        self.resume()
        if not self.exists():
            self._change(new)
            return
        touched = new.select(*self.partition_by).distinct().collect()
        old = self._load(self.path).where(_any_of(self.partition_by, touched))
        self._change(upsert(old, new.select(*self.schema.names), list(self.keys), mode))

    def delete(self, **predicates) -> None:
        """Take out the rows that meet all predicates (all rows, if there are none); rows for which they are unknown stay.

        Partitions without such rows keep their files; one that loses all its rows loses its folder.
        """
        self.resume()
        if not self.exists():
            return
        rows = self._load(self.path)
        where = condition(**predicates)
        hit = F.coalesce(where, F.lit(False)) if where is not None else F.lit(True)
        files = rows.select("*", F.col("_metadata.file_path").alias("_file")).groupBy(*self.partition_by, "_file").agg(F.count_if(hit).alias("gone"), F.count("*").alias("n"))
        found = self._folders(files).groupBy(*self.partition_by, "_folder").agg(F.sum("gone").alias("gone"), F.sum("n").alias("n")).where("gone > 0")
        touched = found.collect()
        if touched:
            emptied = self.spark.createDataFrame([(r["_folder"],) for r in touched if r["gone"] == r["n"]], "folder string")
            self._change(rows.where(_any_of(self.partition_by, touched)).where(~hit), emptied)


def _any_of(columns: tuple[str, ...], rows: Iterable):
    """Whether a row lies in one of the partitions; on partition columns, so that Spark lists no other folder."""
    if len(columns) == 1:
        c, values = columns[0], [r[columns[0]] for r in rows]
        out = F.col(c).isin([v for v in values if v is not None])
        return out | F.col(c).isNull() if None in values else out
    out = F.lit(False)
    for r in rows:
        one = F.lit(True)
        for c in columns:
            one = one & F.col(c).eqNullSafe(F.lit(r[c]))
        out = out | one
    return out
