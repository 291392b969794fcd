"""Centroid clustering in whole numbers by Lloyd's rounds, of which each looks only at what changed (delta Lloyd).

Components become floor(SCALE * x). The first centroids are the vectors whose ids' salted sha256 is least. In each round
every vector goes to the nearest centroid by squared Euclidean distance (ties: the smaller number), and then every centroid that
has vectors moves to the floored mean of each component. Last, vectors are assigned once more.

What persists are the assignments (owner and distance of each vector) and the sums and counts of each centroid. A round
compares a vector with the centroids that moved in the last one; only a vector whose own centroid moved away from it
is compared with all, as no centroid that stayed has come nearer. Vectors that change owner are subtracted from
the sums of the old one and added to those of the new one: the round's signed transfers, summed by the executors.
Where no centroid moved, the rest of the rounds would change nothing and are left out.

Vectors are packed once into blocks of BLOCK rows, as they come, so neither repeated rows nor ids make a block large. Blocks
and assignments are tables bucketed alike by block: no round shuffles vectors, and what it writes are the assignments
alone. The driver holds the centroids and their sums, whose size is that of the parameters. All tables lie in the
shared folder, so a lost executor costs its tasks only.

Vectors that are null, have a null or not finite component, or another length than DIM take no part. Repeated rows are
vectors each. A null id takes part, but is no first centroid while there are others; rows with one id are taken in the order of their components.
With fewer vectors than centroids there are as many centroids as vectors; an empty table gives no rows. Vectors with components
beyond WIDE are kept in blocks of their own and calculated in Python's integers, all compared in each round; distances and inertia
beyond 64 bits are given as the largest number of 64 bits. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, partitions

CENTROIDS, ROUNDS, SCALE, DIM, SALT = 8, 10, 1024, 64, "3"
BLOCK, BUCKET = 4096, 64
#: Scaled components below this keep all sums of DIM products exact in doubles.
WIDE = 1 << 21
_MOST = 2**63 - 1
#: Sums are sent in digits of this many bits, so that no total leaves 64 bits.
_DIGIT = 32

_TRANSFER = pa.struct([("centroid", pa.int32()), ("digit", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.int64()))])
STATE = "block bigint, owners binary, distances binary, transfers array<struct<centroid:int,digit:int,n:bigint,sums:array<bigint>>>"


def _floored(x: np.ndarray) -> np.ndarray:
    """floor(SCALE * x) as Python's integers."""
    return np.array([int(y) * SCALE if abs(y) >= 2.0**53 else math.floor(SCALE * y) for y in x.ravel().tolist()], object).reshape(x.shape)


def _packed(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[pa.RecordBatch]:
    """Rows (vec_id, v) as blocks: a number, ids, whether components are wide, and the components."""
    at = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32
    held: dict[bool, list[tuple[pa.Array, np.ndarray]]] = {False: [], True: []}

    def block(wide: bool) -> pa.RecordBatch:
        nonlocal at
        ids = pa.concat_arrays([i for i, _ in held[wide]])
        data = np.concatenate([x for _, x in held[wide]]).tobytes()
        held[wide] = []
        at += 1
        ids = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
        return pa.RecordBatch.from_arrays([pa.array([at - 1]), ids, pa.array([wide]), pa.array([data], pa.binary())], names=["block", "ids", "wide", "data"])

    for batch in batches:
        x = np.array(batch.column("v").flatten(), np.float64).reshape(batch.num_rows, dim)
        with np.errstate(over="ignore"):
            far = (np.abs(SCALE * x) >= WIDE).any(axis=1)
        for wide in (False, True):
            rows = np.flatnonzero(far == wide)
            while len(rows):
                part, rows = np.split(rows, [BLOCK - sum(len(i) for i, _ in held[wide])])
                values = x[part] if wide else np.floor(SCALE * x[part]).astype("<i4")
                held[wide].append((batch.column("vec_id").take(pa.array(part)), values))
                if sum(len(i) for i, _ in held[wide]) == BLOCK:
                    yield block(wide)
    for wide in (False, True):
        if held[wide]:
            yield block(wide)


@dataclass
class Round:
    """The centroids of a round, and which of them moved since the one before."""

    centroids: list[list[int]]
    moved: list[int]

    def doubles(self) -> np.ndarray:
        return np.array(self.centroids, np.float64)

    def exact(self) -> bool:
        return all(abs(x) < WIDE for c in self.centroids for x in c)


def _distances(x: np.ndarray, norms: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return (norms[:, None] - 2 * (x @ centroids.T) + (centroids * centroids).sum(axis=1)).astype(np.int64)


def assign(x: np.ndarray, owners: np.ndarray, distances: np.ndarray, now: Round) -> tuple[np.ndarray, np.ndarray]:
    """New owners and distances of narrow vectors; an owner of -1 has none yet."""
    x, c, moved = x.astype(np.float64), now.doubles(), np.array(now.moved, np.int64)
    norms = (x * x).sum(axis=1)
    near = _distances(x, norms, c[moved])  # to the centroids that moved, in order
    column = np.full(len(c) + 1, -1)
    column[moved] = np.arange(len(moved))
    own = column[owners]
    left = own >= 0  # whose owner moved
    at = np.where(left, near[np.arange(len(x)), np.maximum(own, 0)], distances)
    away = (left & (at > distances)) | (owners < 0)
    owners, distances = owners.copy(), at
    first = near.argmin(axis=1)  # the smallest number of equal ones
    best, which = near[np.arange(len(x)), first], moved[first]
    nearer = ~away & ((best < distances) | ((best == distances) & (which < owners)))
    owners[nearer], distances[nearer] = which[nearer], best[nearer]
    rows = np.flatnonzero(away)
    if len(rows):
        every = _distances(x[rows], norms[rows], c)
        owners[rows] = every.argmin(axis=1)
        distances[rows] = every.min(axis=1)
    return owners, distances


def assign_wide(x: np.ndarray, now: Round) -> tuple[np.ndarray, np.ndarray]:
    """The same for vectors in Python's integers, with all centroids."""
    every = np.stack([((x - np.array(c, object)) ** 2).sum(axis=1) for c in now.centroids], axis=1)
    owners = np.array([row.index(min(row)) for row in every.tolist()], np.int64)
    return owners, np.array([min(int(min(row)), _MOST) for row in every.tolist()], np.int64)


def transfers(x: np.ndarray, before: np.ndarray, after: np.ndarray) -> list[dict]:
    """Signed counts and sums, in digits, of the vectors that changed owner."""
    out = []
    gone = np.flatnonzero(before != after)
    for c in np.unique(np.concatenate([before[gone], after[gone]])).tolist():
        if c < 0:
            continue
        plus, minus = gone[after[gone] == c], gone[before[gone] == c]
        sums = [int(s) for s in x[plus].sum(axis=0) - x[minus].sum(axis=0)]
        n, digit = len(plus) - len(minus), 0
        while n or any(sums):
            low = [abs(s) % (1 << _DIGIT) * (1 if s > 0 else -1) for s in sums]
            out.append({"centroid": c, "digit": digit, "n": n, "sums": low})
            sums, n, digit = [(s - y) >> _DIGIT if s > 0 else -((y - s) >> _DIGIT) for s, y in zip(sums, low, strict=True)], 0, digit + 1
    return out


def _step(batches: Iterator[pa.RecordBatch], now: Round, dim: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            value = lambda name: batch.column(name)[i].as_py()  # noqa: B023, E731
            data, wide = value("data"), value("wide")
            x = _floored(np.frombuffer(data, "<f8").reshape(-1, dim)) if wide else np.frombuffer(data, "<i4").reshape(-1, dim).astype(np.int64)
            if value("owners") is None:
                before, far = np.full(len(x), -1, np.int64), np.full(len(x), _MOST)
            else:
                before, far = np.frombuffer(value("owners"), "<i4").astype(np.int64), np.frombuffer(value("distances"), "<i8")
            if wide or not now.exact():
                owners, distances = assign_wide(x.astype(object), now)
            else:
                owners, distances = assign(x, before, far, now)
            yield pa.RecordBatch.from_arrays(
                [pa.array([value("block")], pa.int64()), pa.array([owners.astype("<i4").tobytes()], pa.binary()), pa.array([distances.astype("<i8").tobytes()], pa.binary()), pa.array([transfers(x, before, owners)], pa.list_(_TRANSFER))],
                names=["block", "owners", "distances", "transfers"],
            )


def _assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """vec_id, cluster and distance of each row."""
    for batch in batches:
        for i in range(batch.num_rows):
            owners, distances = (np.frombuffer(batch.column(n)[i].as_py(), t) for n, t in (("owners", "<i4"), ("distances", "<i8")))
            yield pa.RecordBatch.from_arrays([batch.column("ids")[i].values, pa.array(owners, pa.int32()), pa.array(distances, pa.int64())], names=["vec_id", "cluster", "distance"])


class Bucketed:
    """Tables bucketed alike by block, in the catalog while they are in use, their files in the shared folder."""

    def __init__(self, space: Workspace, buckets: int):
        self.space, self.buckets, self.names = space, buckets, {}

    def written(self, df: DataFrame, name: str) -> DataFrame:
        table = f"blocks_{uuid.uuid4().hex}"
        path = f"{self.space.folder}/{table}"
        df.write.bucketBy(self.buckets, "block").option("compression", "zstd").option("path", path).saveAsTable(table)
        self.space.paths.setdefault(name, []).append(path)
        self.names[name] = table
        return self.space.spark.table(table)

    def drop(self, name: str) -> None:
        self.space.spark.sql(f"DROP TABLE IF EXISTS {self.names.pop(name)}")
        self.space.drop(name)


def first_centroids(rows: DataFrame, k: int, salt: str) -> list[list[int]]:
    """The vectors of the least hashes, in order: k rows."""
    order = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("vec_id").cast("string")), 256)
    floored = F.transform("v", lambda x: F.floor(x * SCALE))
    found = rows.select("v", order.alias("hash"), floored.alias("floored")).orderBy(F.asc_nulls_last("hash"), "floored", "v").limit(k).collect()
    return [_floored(np.array(r["v"], np.float64)).tolist() for r in found]


def clustered(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, dim: int = DIM, salt: str = SALT) -> tuple[DataFrame, list[list[int]]]:
    """vec_id, cluster and distance of each kept vector, and the last centroids."""
    spark = vectors.sparkSession
    space = Workspace(spark)
    fits = (F.size("embedding") == dim) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    rows = vectors.where(F.col("embedding").isNotNull() & fits).select(F.col("vec_id").cast("bigint").alias("vec_id"), F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    centroids = first_centroids(rows, k, salt)
    if not centroids:
        space.keep()
        return spark.createDataFrame([], "vec_id bigint, cluster int, distance bigint"), centroids
    # as a table first: which rows are in a block must not change when a task runs again
    packed = space.written(rows.mapInArrow(lambda b: _packed(b, dim), "block bigint, ids array<bigint>, wide boolean, data binary"), "packed")
    buckets = min(max(1, -(-packed.count() // BUCKET)), 100_000)
    tables = Bucketed(space, buckets)
    blocks = tables.written(packed.repartition(buckets, "block"), "blocks")
    space.drop("packed")
    sums, counts = [[0] * dim for _ in centroids], [0] * len(centroids)
    now, state = Round(centroids, list(range(len(centroids)))), None
    for at in range(rounds + 1):
        if state is None:
            met = blocks.select("block", "wide", "data", F.lit(None).cast("binary").alias("owners"), F.lit(None).cast("binary").alias("distances"))
        else:
            met = blocks.select("block", "wide", "data").join(state.select("block", "owners", "distances").hint("shuffle_hash"), "block")
        state = tables.written(met.mapInArrow(lambda b, now=now: _step(b, now, dim), STATE), f"state{at}")
        if at:
            tables.drop(f"state{at - 1}")
        if at == rounds:
            break
        moves = state.select(F.explode("transfers").alias("t"))
        for r in moves.groupBy("t.centroid", "t.digit").agg(F.sum("t.n").alias("n"), *[F.sum(F.col("t.sums")[i]).alias(f"s{i}") for i in range(dim)]).collect():
            counts[r["centroid"]] += r["n"]
            for i in range(dim):
                sums[r["centroid"]][i] += r[f"s{i}"] << (_DIGIT * r["digit"])
        new = [[s // n for s in own] if n else old for own, n, old in zip(sums, counts, now.centroids, strict=True)]
        moved = [c for c, (a, b) in enumerate(zip(new, now.centroids, strict=True)) if a != b]
        if not moved:
            break
        now = Round(new, moved)
    final = blocks.select("block", "ids").join(state.select("block", "owners", "distances").hint("shuffle_hash"), "block")
    out = space.written(final.mapInArrow(_assigned, "vec_id bigint, cluster int, distance bigint"), "assigned")
    for name in list(tables.names):
        tables.drop(name)
    return out, now.centroids


def clusters(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, dim: int = DIM, salt: str = SALT) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of each kept vector."""
    out, centroids = clustered(vectors, k, rounds, dim, salt)
    inertia = {r["cluster"]: int(r["s"]) for r in out.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}  # a row for each centroid
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    of_cluster = lambda values: F.element_at(F.array(*map(F.lit, values)), F.col("cluster") + 1) if values else F.lit(None)
    own = [min(inertia.get(c, 0), _MOST) for c in range(len(centroids))]
    return out.select(
        "vec_id", "cluster", "distance", of_cluster(own).cast("bigint").alias("cluster_inertia"), F.lit(min(sum(inertia.values()), _MOST)).cast("bigint").alias("inertia"), of_cluster(names).cast("string").alias("centroid_sha256"),
    )
