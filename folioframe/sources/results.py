"""The store of segment results: a table of versions that are only ever added."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioframe.operators.scale import first_per_key
from folioframe.session import cut, hadoop_folder

SCHEMA = "version long, kind string, doc_hash string, seg_idx long, result string"
# Kinds of rows: a result, a document that no longer counts, an end to all before, and a result of a compacted version.
SET, DROP, CLEAR, BASE = "set", "drop", "clear", "base"


def doc_hash(namespace: str, content: Column) -> Column:
    """The address of a document's results: its content under a namespace."""
    return F.left(F.sha2(F.concat(F.lit(namespace.encode() + b"\0"), content.cast("binary")), 256), F.lit(20))


class ResultStore:
    """Results by (doc_hash, seg_idx); the newest version wins.

    Every change is a folder of its own that counts once its writer has committed
    it; a job that dies leaves nothing that is read, and one that runs again adds only
    what is missing. Removals are rows too. `compact` writes the present state as a
    version that stands for all before it.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self._spark, self._folder = spark, folder.rstrip("/")

    def versions(self) -> list[int]:
        """Committed versions, oldest first."""
        place, files = hadoop_folder(self._spark, self._folder)
        if not files.exists(place):
            return []
        names = [s.getPath() for s in files.listStatus(place)]
        done = [p for p in names if p.getName().startswith("version-") and files.exists(p.suffix("/_SUCCESS"))]
        return sorted(int(p.getName().split("-")[1]) for p in done)

    def _path(self, version: int) -> str:
        return f"{self._folder}/version-{version:012d}"

    def _next(self) -> int:
        """One more than any version there is, committed or not."""
        place, files = hadoop_folder(self._spark, self._folder)
        if not files.exists(place):
            return 1
        return 1 + max([int(s.getPath().getName().split("-")[1]) for s in files.listStatus(place) if s.getPath().getName().startswith("version-")], default=0)

    def _add(self, rows: DataFrame, kind: str) -> int:
        version = self._next()
        columns = [F.lit(version).cast("long").alias("version"), F.lit(kind).alias("kind")]
        columns += [(F.col(c) if c in rows.columns else F.lit(None)).cast(t).alias(c) for c, t in (("doc_hash", "string"), ("seg_idx", "long"), ("result", "string"))]
        rows.select(*columns).write.parquet(self._path(version))
        return version

    def read(self, version: int | None = None) -> DataFrame:
        """doc_hash, seg_idx, result as of a version, or now."""
        there = [v for v in self.versions() if version is None or v <= version]
        if not there:
            return self._spark.createDataFrame([], SCHEMA).select("doc_hash", "seg_idx", "result")
        rows = self._spark.read.schema(SCHEMA).parquet(*[self._path(v) for v in there])
        # Nothing in front of the last clear or compacted version counts.
        floor = rows.filter(F.col("kind").isin(CLEAR, BASE)).agg(F.coalesce(F.max("version"), F.lit(0))).scalar()
        live = rows.filter(F.col("version") >= floor)
        dropped = live.filter(F.col("kind") == DROP).groupBy("doc_hash").agg(F.max("version").alias("_dropped"))
        newest = live.filter(F.col("kind").isin(SET, BASE)).groupBy("doc_hash", "seg_idx").agg(F.max(F.struct("version", "result")).alias("_r"))
        kept = newest.join(dropped, "doc_hash", "left").filter(F.col("_dropped").isNull() | (F.col("_r.version") > F.col("_dropped")))
        return kept.select("doc_hash", "seg_idx", F.col("_r.result").alias("result"))

    def set(self, results: DataFrame) -> int | None:
        """Add results (doc_hash, seg_idx, result) that are not there yet; the version, or None if there was nothing to add.

        Of several results for a segment the greatest counts. Null addresses are left out.
        """
        clean = results.filter("doc_hash is not null and seg_idx is not null").select("doc_hash", F.col("seg_idx").cast("long").alias("seg_idx"), "result")
        news = first_per_key(clean, ["doc_hash", "seg_idx"], F.desc("result"))
        held = self.read().withColumnRenamed("result", "_held").withColumn("_there", F.lit(True))
        fresh = cut(news.join(held, ["doc_hash", "seg_idx"], "left").filter(F.col("_there").isNull() | ~F.col("result").eqNullSafe(F.col("_held"))).select("doc_hash", "seg_idx", "result"))
        return None if fresh.isEmpty() else self._add(fresh, SET)

    def invalidate(self, documents: DataFrame) -> int | None:
        """Forget the results of documents (doc_hash); None if there were none."""
        gone = cut(self.read().select("doc_hash").distinct().join(documents.select("doc_hash"), "doc_hash", "left_semi"))
        return None if gone.isEmpty() else self._add(gone, DROP)

    def clear(self) -> int | None:
        """Forget all results."""
        return None if self.read().isEmpty() else self._add(self._spark.range(1), CLEAR)

    def totals(self) -> DataFrame:
        """doc_hash and its number of results."""
        return self.read().groupBy("doc_hash").agg(F.count(F.lit(1)).alias("n"))

    def compact(self, keep: int = 0) -> int | None:
        """Write the present state as one version and remove those before it but the last `keep`."""
        before = self.versions()
        if len(before) < 2:
            return None
        state = cut(self.read())
        # An empty state is a clear.
        version = self._add(self._spark.range(1), CLEAR) if state.isEmpty() else self._add(state, BASE)
        for old in before[: len(before) - keep]:
            place, files = hadoop_folder(self._spark, self._path(old))
            files.delete(place, True)
        return version
