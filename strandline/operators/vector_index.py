"""An inverted-list index of an EMBEDDING column: flushed vectors by their nearest centre, searched in the lists nearest to a query, with the versions after it merged in.

The centres are fitted by k-means in the JVM on a bounded sample (``SAMPLE`` vectors by hash); every flushed vector is in a list. A search reads the ``probes`` lists whose centres are nearest (partition
pruning). How many that takes depends on the data: it is measured when the index is built, as the least number that finds ``RECALL`` of the ten nearest of ``ASKED`` sampled vectors among the sample. Where
neighbours lie close together that is a few lists; with vectors that are spread evenly in many dimensions it is most of them. ``probes`` of all lists is exact. Keys that were written after the index was built are taken out of the lists and searched exactly in the
log, so a changed vector replaces its old one at once. The state (centres, commit, files) is a versioned file that only one writer can create.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import vector
from . import versions as V

#: Vectors that the centres are fitted on, and the most lists.
SAMPLE, MOST_LISTS = 65_536, 4096
#: The share of true neighbours that a search shall find, the vectors it is measured with, and those they are compared with.
RECALL, ASKED, COMPARED = 0.97, 200, 20_000
#: Stands for a list of what was written after the build.
FRESH = -1
#: Metrics whose neighbours lie in near lists; others are searched exactly.
INDEXED = ("cosine", "l2")


def measured_probes(x: np.ndarray, centers: np.ndarray, recall: float = RECALL, k: int = 10) -> int:
    """The least number of lists that hold ``recall`` of the ``k`` nearest sampled vectors of the first ``ASKED`` ones."""
    gap = lambda a, b: (a * a).sum(axis=1)[:, None] - 2 * a @ b.T + (b * b).sum(axis=1)[None, :]
    asked = x[:ASKED]
    to = gap(x, centers).argmin(axis=1)
    rank = np.argsort(np.argsort(gap(asked, centers), axis=1, kind="stable"), axis=1, kind="stable")
    near = np.argpartition(gap(asked, x), min(k, len(x)) - 1, axis=1)[:, : min(k, len(x))]
    needed = np.sort(np.take_along_axis(rank, to[near], axis=1).ravel()) + 1
    return int(needed[max(0, math.ceil(recall * len(needed)) - 1)])


class VectorIndex:
    """The index of one column of a table."""

    def __init__(self, log, column: str, metric: str):
        self.log, self.table, self.column, self.metric = log, log.table, column, metric.lower()
        self.store, self.spark = log.store, log.spark
        self.folder = [*log.folder, "index", str(log.table.column(column).column_id)]

    def state(self) -> dict | None:
        """What is built for the metric, if anything is."""
        found = self.store.state(*self.folder)[1]
        return found if found and found["metric"] == self.metric else None

    def _keys(self) -> list[str]:
        return [*([V.USER] if self.table.by_user else []), self.table.pk]

    def _place(self, v):
        """A vector as it is compared with centres: of length one for cosines."""
        wide = F.transform(v, lambda x: x.cast("double"))
        if self.metric != "cosine":
            return wide
        norm = F.sqrt(F.aggregate(wide, F.lit(0.0), lambda s, x: s + x * x))
        return F.transform(F.arrays_zip(wide.alias("x"), F.array_repeat(norm, F.size(wide)).alias("n")), lambda e: F.when(e["n"] > 0, e["x"] / e["n"]).otherwise(e["x"]))

    def build(self) -> int:
        """Put all current flushed vectors into lists; returns how many."""
        version, old = self.store.state(*self.folder)
        commit = self.log.last_commit()
        rows = self.log.current(snapshot=commit).filter(F.col(self.column).isNotNull()).select(*self._keys(), F.col(self.column).alias("v")).withColumn("place", array_to_vector(self._place(F.col("v"))))
        n = rows.count()
        lists = max(1, min(MOST_LISTS, math.isqrt(n)))
        state = {"metric": self.metric, "commit": commit, "rows": n, "path": None, "centers": []}
        if n:
            part = F.pmod(F.xxhash64(F.lit(51), self.table.pk), F.lit(1 << 40)) / float(1 << 40)
            sample = rows.filter(part < SAMPLE / n).select("place")
            model = KMeans(k=lists, seed=1, maxIter=10, featuresCol="place", predictionCol="list").fit(sample if sample.take(1) else rows.select("place"))
            state["centers"] = [c.tolist() for c in model.clusterCenters()]
            few = rows.filter(part < COMPARED / n).select("place").collect() or rows.select("place").take(1)
            state["probes"] = measured_probes(np.array([r["place"].toArray() for r in few]), np.array(state["centers"]))
            state["path"] = f"lists-{uuid.uuid4().hex}"
            # a list is a folder of as many files as its size asks for
            model.transform(rows).drop("place").repartition("list").write.option("compression", "zstd").partitionBy("list").parquet(self.store.uri(*self.folder, state["path"]))
        if not self.store.swap(state, version, *self.folder):
            if state["path"]:
                self.store.delete(*self.folder, state["path"])
            return 0  # another job built it
        for name in self.store.names(*self.folder):  # the version before stays for its readers
            if name.startswith("lists-") and name not in (state["path"], (old or {}).get("path")):
                self.store.delete(*self.folder, name)
        return n

    def _newest(self, state: dict, user: str | None) -> DataFrame:
        """The last versions of the keys that were written since the index was built."""
        fresh = self.log.log(after_commit=state["commit"], user=user).filter(F.col(V.COMMIT) > state["commit"])
        return V.resolve(fresh, self.table.pk, self.table.by_user, None, include_deleted=True)

    def _listed(self, state: dict, newest: DataFrame) -> DataFrame:
        """The rows of the lists that still hold: list, keys and vector."""
        schema, keys = self.log.table.schema(), self._keys()
        kept = self.spark.read.parquet(self.store.uri(*self.folder, state["path"]))
        kept = kept.select("list", *(F.col(k).cast(schema[k].dataType).alias(k) for k in keys), F.col("v").cast(schema[self.column].dataType).alias(self.column))
        return kept.join(newest.select(*keys), keys, "left_anti")

    def candidates(self, query: list[float], user: str | None = None, probes: int | None = None) -> DataFrame | None:
        """Keys and vectors that can be near a query: those of its nearest lists, and all written since. None if nothing is built."""
        state = self.state()
        if state is None:
            return None
        keys, own = self._keys(), F.col(self.column)
        newest = self._newest(state, user)
        out = newest.filter(~F.col(V.DELETED)).select(*keys, own)
        if state["path"]:
            centers, q = np.array(state["centers"]), np.array(query, np.float64)
            if self.metric == "cosine" and np.linalg.norm(q) > 0:
                q = q / np.linalg.norm(q)
            if len(q) != centers.shape[1]:
                raise ValueError(f"vectors differ in length: {centers.shape[1]} {len(q)}")
            near = np.argsort(((centers - q) ** 2).sum(axis=1), kind="stable")[: probes or state["probes"]].tolist()
            out = self._listed(state, newest).filter(F.col("list").isin(near)).select(*keys, own).unionByName(out)
        return out if user is None else out.filter(F.col(V.USER) == user)

    def search_many(self, asked: DataFrame, k: int = vector.DEFAULT_TOP_K, user: str | None = None, probes: int | None = None) -> DataFrame | None:
        """The ``k`` nearest of the candidates of every row of ``asked`` (asked, q) at once: (asked, near, seen) as of :func:`vector.nearest_of_many`. None if nothing is built.

        Small lists share a bucket and large ones are dealt to several, so no task holds more than about ``vector.BUCKET`` rows; a query goes to the buckets of its lists."""
        state = self.state()
        if state is None:
            return None
        newest = self._newest(state, user)
        rows = newest.filter(~F.col(V.DELETED)).select(F.lit(FRESH).alias("list"), *self._keys(), self.column)
        if state["path"]:
            rows = self._listed(state, newest).unionByName(rows)
        rows = rows.filter(F.col(self.column).isNotNull() & (F.lit(True) if user is None else F.col(V.USER) == user))
        first, parts, last, free = {}, {}, -1, 0
        for r in sorted(rows.groupBy("list").count().collect()):  # at most MOST_LISTS and one
            parts[r["list"]] = math.ceil(r["count"] / vector.BUCKET)
            if r["count"] > free:
                first[r["list"]], last = last + 1, last + parts[r["list"]]
                free = vector.BUCKET if parts[r["list"]] == 1 else 0
            else:
                first[r["list"]] = last
            free = max(0, free - r["count"])
        dealt = rows.join(F.broadcast(self.spark.createDataFrame([(x, first[x], parts[x]) for x in first], "list int, first int, parts int")), "list")
        bucket = F.col("first") + F.pmod(F.xxhash64(self.table.pk), F.col("parts")).cast("int")
        dealt = dealt.select(bucket.alias("bucket"), "list", F.col(self.table.pk).alias("key"), F.col(self.column).alias("v"))
        centers, cosine, most = np.array(state["centers"]), self.metric == "cosine", probes or state.get("probes", 0)
        schema = T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("lists", T.ArrayType(T.IntegerType())), asked.schema["asked"], asked.schema["q"]])

        fresh = FRESH

        def probed(batches):  # by value: the executors need nothing of this package
            import numpy as np
            import pyarrow as pa
            from pyspark.sql.pandas.types import to_arrow_schema

            to = to_arrow_schema(schema)
            for batch in batches:
                index, buckets, lists = [], [], []
                for i, v in enumerate(batch.column("q").to_pylist()):
                    q, near = np.array(v, np.float64), []
                    if len(centers):
                        if len(q) != centers.shape[1]:
                            raise ValueError(f"vectors differ in length: {centers.shape[1]} {len(q)}")
                        if cosine and np.linalg.norm(q) > 0:
                            q = q / np.linalg.norm(q)
                        near = np.argsort(((centers - q) ** 2).sum(axis=1), kind="stable")[:most].tolist()
                    own = {}
                    for x in (x for x in [*near, fresh] if x in first):
                        for b in range(first[x], first[x] + parts[x]):
                            own.setdefault(b, []).append(x)
                    index += [i] * len(own)
                    buckets += own.keys()
                    lists += own.values()
                taken = batch.select(["asked", "q"]).take(pa.array(index, pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(buckets, pa.int32()), pa.array(lists, pa.list_(pa.int32())), taken.column(0), taken.column(1)], names=to.names)

        return vector.in_buckets(dealt, asked.filter("q IS NOT NULL").select("asked", "q").mapInArrow(probed, schema), k, self.metric)
