"""k-means by balls, in whole numbers: the result of the plain algorithm with fewer distances.

Vectors become integers, floor(scale * x), so every distance and mean is exact. A cluster is a ball: its
centroid and the largest distance of its members. Only centroids within twice the radius can take a member
away; these are its neighbours, in order of distance. A member nearer than half the way to the first
neighbour is in the stable core and compared with none. The others lie in annuli between one half distance and
the next, and each annulus is compared with the neighbours up to its own. At equality both are compared, as the
smaller number wins ties. Workers do this for gathered batches, with the batch's own radii, which are tighter.

A round is a pass over the vectors with the centroids in the closure (k * dims numbers), which writes the
vectors with their new clusters, and a sum by cluster, pre-aggregated in each task. The driver holds k centroids.
All vectors begin in cluster 0, whose ball then holds them all.

Defined results: a vector counts if it has exactly `dims` components, none null or not finite, and none of
2^27 or more after scaling (a squared distance wouldn't fit 64 bits); others are left out. Starts are the k
vectors with the smallest hashes of their ids, ties by their components; a vector without an id is clustered but
never a start. Rows are clustered each, repeated ones alike. With fewer vectors than k there are fewer clusters;
an empty table gives an empty table. A cluster that loses all members keeps its centroid. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from loomframe.llm.common import dropped, written

K, ROUNDS, SEED, DIMS, SCALE = 40, 5, 2, 64, 256
#: Scaled components stay under this.
MOST = 1 << 27
#: Vectors that a worker compares at once.
GATHERED = 8192


def whole_numbers(vectors: DataFrame, vec_id: str, embedding: str, dims: int, scale: int) -> DataFrame:
    """(id, q): the vectors that count, as integers."""
    fits = lambda x: F.coalesce(~F.isnan(x) & (F.abs(x.cast("double") * scale) < MOST), F.lit(False))
    rows = vectors.select(F.col(f"`{vec_id}`").alias("id"), F.col(f"`{embedding}`").alias("v"))
    rows = rows.where(F.when(F.size("v") == dims, F.forall("v", fits)).otherwise(False))
    return rows.select("id", F.transform("v", lambda x: F.floor(x.cast("double") * scale).cast("int")).alias("q"))


def starts(rows: DataFrame, k: int, seed: int) -> list[list[int]]:
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")).cast("binary"), 256)
    first = rows.where("id is not null").select(digest.alias("digest"), "q").orderBy("digest", "q").limit(k)
    return [list(r.q) for r in first.collect()]  # k rows


class Balls:
    """Nearest centroids of vectors whose cluster is known."""

    def __init__(self, centroids: list[list[int]]) -> None:
        self.centroids = np.array(centroids, np.int64)
        k = len(centroids)
        away = np.stack([self.distances(self.centroids, j) for j in range(k)])
        #: By cluster the others in order of distance, and the least squared distance of a member that must be compared
        #: with each: a quarter of the centroids' squared distance, rounded up.
        self.others = [[i for i in np.argsort(away[j], kind="stable").tolist() if i != j] for j in range(k)]
        self.from_here = [-(-away[j][self.others[j]] // 4) for j in range(k)]
        self.compared = 0

    def distances(self, vectors: np.ndarray, j: int) -> np.ndarray:
        apart = vectors - self.centroids[j]
        return np.einsum("nd,nd->n", apart, apart)

    def assigned(self, vectors: np.ndarray, clusters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(clusters, squared distances): the nearest centroids, ties to the smaller number."""
        found, least = clusters.copy(), np.zeros(len(vectors), np.int64)
        for j in np.unique(clusters).tolist():
            ball = np.flatnonzero(clusters == j)
            own = self.distances(vectors[ball], j)
            self.compared += len(ball)
            # how many neighbours each member's annulus is compared with: none in the core
            reach = np.searchsorted(self.from_here[j], own, side="right")
            order = np.argsort(-reach, kind="stable")
            ball, reach, best = ball[order], reach[order], own[order]
            to = np.full(len(ball), j)
            for place, i in enumerate(self.others[j][: reach[0]]):
                n = int(np.searchsorted(-reach, -place, side="left"))
                d = self.distances(vectors[ball[:n]], i)
                self.compared += n
                better = (d < best[:n]) | (d == best[:n]) & (i < to[:n])
                best[:n] = np.where(better, d, best[:n])
                to[:n] = np.where(better, i, to[:n])
            found[ball], least[ball] = to, best
        return found, least


def gathered(batches: Iterator[pa.RecordBatch], most: int = GATHERED) -> Iterator[pa.Table]:
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= most:
            yield pa.Table.from_batches(held)
            held = []
    if held:
        yield pa.Table.from_batches(held)


def matrix(table: pa.Table, dims: int) -> np.ndarray:
    return np.asarray(table["q"].combine_chunks().flatten()).reshape(-1, dims).astype(np.int64)


def assign(rows: DataFrame, centroids: list[list[int]], dims: int) -> DataFrame:
    """rows (id, q, cluster) with the nearest cluster and its squared distance."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        balls = Balls(centroids)
        for table in gathered(batches):
            if table.num_rows:
                to, least = balls.assigned(matrix(table, dims), np.asarray(table["cluster"]))
                yield from pa.table([table["id"], table["q"], pa.array(to, pa.int32()), pa.array(least, pa.int64())], names=["id", "q", "cluster", "distance"]).to_batches()

    return rows.mapInArrow(run, StructType([rows.schema["id"], rows.schema["q"], StructField("cluster", IntegerType()), StructField("distance", LongType())]))


def moved(rows: DataFrame, centroids: list[list[int]], dims: int) -> list[list[int]]:
    """Each centroid as the floor of its members' mean; without members as it was."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(len(centroids), np.int64), np.zeros((len(centroids), dims), np.int64)
        for table in gathered(batches):
            if table.num_rows:
                vectors, clusters = matrix(table, dims), np.asarray(table["cluster"])
                order = np.argsort(clusters, kind="stable")
                there, begin = np.unique(clusters[order], return_index=True)
                total[there] += np.add.reduceat(vectors[order], begin, axis=0)
                n += np.bincount(clusters, minlength=len(n))
        some = np.flatnonzero(n)
        yield pa.record_batch([pa.array(some, pa.int32()), pa.array(n[some]), pa.array(total[some].tolist(), pa.list_(pa.int64()))], names=["cluster", "n", "total"])

    parts = rows.select("q", "cluster").mapInArrow(sums, "cluster int, n long, total array<long>")
    parts = parts.select("cluster", "n", F.posexplode("total").alias("at", "x")).groupBy("cluster", "at").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
    after = [list(c) for c in centroids]
    for r in parts.collect():  # k * dims rows
        after[r.cluster][r.at] = r.x // r.n
    return after


def ball_kmeans(
    vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", k: int = K, rounds: int = ROUNDS, seed: int = SEED, dims: int = DIMS, scale: int = SCALE
) -> tuple[DataFrame, list[list[int]]]:
    """((id, q, cluster, distance) of every vector that counts, the final centroids)."""
    rows = whole_numbers(vectors, vec_id, embedding, dims, scale)
    centroids = starts(rows, k, seed)
    if not centroids:
        # without a start there is no cluster: no vector has an id
        return written(rows.where("false").select("id", "q", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), "balls"), []
    rows, before = rows.withColumn("cluster", F.lit(0)), None
    for _ in range(rounds):
        rows = written(assign(rows, centroids, dims), "balls")
        if before is not None:
            dropped(before)
        before, centroids = rows, moved(rows, centroids, dims)
    last = written(assign(rows, centroids, dims), "balls")
    if before is not None:
        dropped(before)
    return last, centroids


def with_inertia(rows: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """rows with the sums of squared distances, of the cluster and of all, and a digest of the centroid."""
    sums = {r.cluster: r.s for r in rows.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # k rows
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    facts = [(j, s, sum(sums.values()), digests[j]) for j, s in sums.items()]
    facts = rows.sparkSession.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(facts), "cluster")  # k rows
