"""Centroid clustering by ball k-means, exact in integers.

Vectors lie in blocks, each with the cluster (`home`) of every vector as last stored. When centroids move, the members of
a cluster within a block form a ball: its radius is the largest distance of a member to the moved centroid. Another
centroid can only matter to the ball if it lies within twice the radius, which gives the ball's neighbours. Half the
distances to the neighbours, in ascending order, cut the ball into a stable core, whose members keep their home without
any comparison, and annuli: a member of annulus t is compared with the nearest t neighbours only. All comparisons are of
squared distances in integers (4 * d(x, own)^2 < d(own, other)^2 rules the other out, ties included), so the result is that
of comparing every vector with every centroid. Before the first assignment all vectors are members of cluster 0.

Centroids (k times the dimension) are the only thing that driver and tasks exchange: each task adds up its blocks and
sends k sums. Homes are stored by checkpoint() in the first round and every `STORE_EVERY` rounds; between stores a task
replays the few sets of centroids since then, which costs less than writing all vectors again. Rounds end early when no
centroid moves, as later ones would change nothing.

Vectors that are null, of another dimension, or hold null or non-finite components are left out; an empty table gives an
empty result, fewer vectors than `k` give as many centroids. A null id is carried along and seeds a centroid only if too
few vectors have ids; repeated rows give repeated results; other columns are left alone. A scaled component beyond
2^27 would overflow 64-bit distances and raises ValueError.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tersely.llm.common import durable, quoted

#: Rounds whose centroids a task replays at most before homes are stored again.
STORE_EVERY = 4
LARGEST = 1 << 27
BLOCK = "ids array<long>, vectors binary, home binary"


def scaled(df: DataFrame, dim: int, scale: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """`vec_id long, v array<long>`: the whole vectors, each component as floor(scale * x)."""
    found = df.select(quoted(id_col).cast("long").alias("vec_id"), quoted(vector_col).cast("array<double>").alias("x"))
    whole = (F.size("x") == dim) & F.forall("x", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return found.filter(whole).select("vec_id", F.transform("x", lambda x: F.floor(x * F.lit(float(scale)))).alias("v"))


def seeds(vectors: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k vectors with the smallest sha256 of `seed:vec_id`."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    return np.array([r.v for r in vectors.select("v", key.alias("key")).orderBy(F.col("key").asc_nulls_last(), "v").limit(k).collect()], dtype=np.int64)


def squared(vectors: np.ndarray, centroid: np.ndarray) -> np.ndarray:
    gap = vectors.astype(np.int64) - centroid
    return np.einsum("ij,ij->i", gap, gap)


class Balls:
    """A set of centroids and the squared distances between them, each centroid's others in ascending order."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids
        gaps = np.stack([squared(centroids, c) for c in centroids])
        self.order = [np.array([j for j in np.argsort(row, kind="stable") if j != i], dtype=np.int64) for i, row in enumerate(gaps)]
        self.gaps = [row[o] for row, o in zip(gaps, self.order, strict=True)]

    def assign(self, vectors: np.ndarray, home: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Each vector's nearest centroid (ties: the smaller number) and squared distance; and how many distances that took."""
        nearest, distance, compared = home.copy(), np.zeros(len(home), dtype=np.int64), len(home)
        for i in np.unique(home).tolist():
            members = np.flatnonzero(home == i)
            own = squared(vectors[members], self.centroids[i])
            distance[members] = own
            neighbours = int(np.searchsorted(self.gaps[i], 4 * int(own.max()), side="right"))
            annulus = np.searchsorted(self.gaps[i][:neighbours], 4 * own, side="right")  # 0: the stable core
            for t in range(neighbours):
                reached = members[annulus > t]
                other = int(self.order[i][t])
                d = squared(vectors[reached], self.centroids[other])
                compared += len(reached)
                better = (d < distance[reached]) | ((d == distance[reached]) & (other < nearest[reached]))
                nearest[reached[better]], distance[reached[better]] = other, d[better]
        return nearest, distance, compared


def replay(vectors: np.ndarray, home: np.ndarray, steps: list[Balls]) -> tuple[np.ndarray, np.ndarray]:
    distance = np.zeros(len(home), dtype=np.int64)
    for balls in steps:
        home, distance, _ = balls.assign(vectors, home)
    return home, distance


def blocks(batch: pa.RecordBatch, dim: int) -> Iterator[tuple[pa.ListScalar, np.ndarray, np.ndarray]]:
    for ids, vectors, home in zip(batch.column("ids"), batch.column("vectors"), batch.column("home"), strict=True):
        yield ids, np.frombuffer(vectors.as_py(), dtype=np.int32).reshape(-1, dim), np.frombuffer(home.as_py(), dtype=np.int32)


def packed(vectors: DataFrame, dim: int) -> DataFrame:
    """Blocks of vectors, one for each Arrow batch, all with home 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                flat = batch.column("v").flatten().to_numpy(zero_copy_only=False)
                if np.abs(flat).max() > LARGEST:
                    raise ValueError(f"a scaled component is beyond {LARGEST}: distances would not fit 64 bits")
                ids = pa.ListArray.from_arrays(pa.array([0, batch.num_rows], pa.int32()), batch.column("vec_id"))
                yield pa.RecordBatch.from_arrays([ids, pa.array([flat.astype(np.int32).tobytes()], pa.binary()), pa.array([np.zeros(batch.num_rows, dtype=np.int32).tobytes()], pa.binary())], names=["ids", "vectors", "home"])

    return vectors.mapInArrow(run, BLOCK)


def stored(state: DataFrame, dim: int, steps: list[Balls]) -> DataFrame:
    """The blocks with the homes that the steps lead to, checkpointed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            homes = [replay(v, home, steps)[0].astype(np.int32).tobytes() for _, v, home in blocks(batch, dim)]
            yield batch.set_column(2, "home", pa.array(homes, pa.binary()))

    return durable(state.mapInArrow(run, BLOCK), "homes")


def sums(state: DataFrame, dim: int, k: int, steps: list[Balls]) -> dict[int, tuple[int, int, list[int]]]:
    """Of each cluster that has members: their number, the sum of their squared distances, the sums of their components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, dim + 2), dtype=np.int64)
        for batch in batches:
            for _, v, home in blocks(batch, dim):
                nearest, distance = replay(v, home, steps)
                for i in np.unique(nearest).tolist():
                    mine = nearest == i
                    total[i, 0] += int(mine.sum())
                    total[i, 1] += int(distance[mine].sum())
                    total[i, 2:] += v[mine].sum(axis=0, dtype=np.int64)
        at = np.flatnonzero(total[:, 0])
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at].tolist(), pa.list_(pa.int64()))], names=["cluster", "totals"])

    each = state.mapInArrow(run, "cluster int, totals array<long>").select("cluster", F.posexplode("totals").alias("at", "total"))
    out: dict[int, list[int]] = {}
    for r in each.groupBy("cluster", "at").agg(F.sum("total").alias("total")).collect():  # k * (dim + 2) rows
        out.setdefault(r.cluster, [0] * (dim + 2))[r["at"]] = r.total
    return {i: (x[0], x[1], x[2:]) for i, x in out.items()}


def cluster(df: DataFrame, k: int = 8, rounds: int = 10, dim: int = 64, scale: int = 1024, seed: int = 3, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, list[Balls]]:
    """The blocks as last stored, and the sets of centroids since then; the last one holds the final centroids."""
    vectors = scaled(df, dim, scale, id_col, vector_col)
    centroids = seeds(vectors, k, seed)
    state, steps = packed(vectors, dim), []
    if not len(centroids):
        return state, steps
    for done in range(rounds):
        steps = [*steps, Balls(centroids)]
        if done % STORE_EVERY == 0:
            state, steps = stored(state, dim, steps), []
        moved = centroids.copy()
        for i, (n, _, total) in sums(state, dim, len(centroids), steps).items():
            moved[i] = [x // n for x in total]
        if np.array_equal(moved, centroids):
            break
        centroids = moved
    return state, [*steps, Balls(centroids)]


def cluster_vectors(df: DataFrame, k: int = 8, rounds: int = 10, dim: int = 64, scale: int = 1024, seed: int = 3, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per vector: its cluster, squared distance to the centroid, that sum over its cluster and over all vectors,
    and the digest of the centroid's components."""
    state, steps = cluster(df, k, rounds, dim, scale, seed, id_col, vector_col)
    final = steps[-1].centroids if steps else np.zeros((0, dim), dtype=np.int64)
    spread = {i: x[1] for i, x in sums(state, dim, len(final), steps).items()} if steps else {}
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in final.tolist()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, v, home in blocks(batch, dim):
                nearest, distance = replay(v, home, steps)
                own, everything = [spread[i] for i in nearest.tolist()], [sum(spread.values())] * len(nearest)
                columns = [ids.values, pa.array(nearest, pa.int32()), pa.array(distance), pa.array(own, pa.int64()), pa.array(everything, pa.int64()), pa.array([digests[i] for i in nearest.tolist()], pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"])

    return state.mapInArrow(run, "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
