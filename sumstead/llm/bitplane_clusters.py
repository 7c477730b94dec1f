"""Operator 11: centroid clustering of whole-number vectors by counting bits of bit planes.

A vector's SIZE components become whole numbers floor(SCALE * x).  Their two's
complement bits are kept as planes: bit p of all components is one 64-bit word,
and a vector is as many words as its batch's largest component needs.  With the
weight of a plane (2^p, the last one negative) the dot product of two vectors
is the weighted sum of popcounts of the ANDs of their planes, so distances
|v|^2 - 2 v.c + |c|^2 are exact, and so are a cluster's sums of components.

Planes are written once.  A round reads them, takes its centroids (``k`` vectors,
in the task's closure) and returns one row of sums for each cluster and task, so
that nothing of a hot cluster or a vector that is repeated often is shuffled.

Vectors of another length or with a null or non-finite component are left out,
repeated rows are clustered each, fewer vectors than ``k`` give as many
centroids, an empty table gives no rows and extra columns are left out.  A null
id is kept but never chosen as a seed before other ids; rows with one id follow
each other by their planes.  Components beyond 2^27 in size stop the job, as
their distances exceed 64 bits.  There are no texts, so none is long.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sumstead.llm.common import read_table
from sumstead.session import cut_lineage

SIZE = 64
SCALE = 64
K = 16
ROUNDS = 3
SEED = 1
_LARGEST = 1 << 27

PLANES = "id bigint, planes binary, norm bigint"
RESULT = ("vec_id bigint, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, "
          "centroid_sha256 string")


def weights(n: int) -> np.ndarray:
    """What a bit of each of ``n`` planes counts."""
    w = np.left_shift(np.int64(1), np.arange(n, dtype=np.int64))
    w[-1] = -w[-1]
    return w


def to_planes(values: np.ndarray) -> np.ndarray:
    """Rows of SIZE whole numbers as rows of as many planes as the largest needs."""
    largest = int(np.maximum(values, ~values).max()) if values.size else 0
    n = largest.bit_length() + 1
    bits = (values[:, None, :] >> np.arange(n, dtype=np.int64)[None, :, None]) & 1
    packed = np.packbits(bits.astype(np.uint8), axis=2, bitorder="little")
    return np.ascontiguousarray(packed).view("<u8").reshape(len(values), n)


def bit_sums(planes: np.ndarray) -> np.ndarray:
    """The sum of each component over rows of planes."""
    bits = np.unpackbits(np.ascontiguousarray(planes).view(np.uint8), axis=1, bitorder="little")
    counts = bits.sum(axis=0, dtype=np.int64).reshape(planes.shape[1], SIZE)
    return weights(planes.shape[1]) @ counts


def products(planes: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Dot products of each row with each of ``others``."""
    total = np.zeros((len(planes), len(others)), dtype=np.int64)
    for p, w in enumerate(weights(planes.shape[1]).tolist()):
        for q, x in enumerate(weights(others.shape[1]).tolist()):
            total += np.bitwise_count(planes[:, p, None] & others[None, :, q]).astype(np.int64) * (w * x)
    return total


def norms(planes: np.ndarray) -> np.ndarray:
    total = np.zeros(len(planes), dtype=np.int64)
    w = weights(planes.shape[1]).tolist()
    for p in range(len(w)):
        for q in range(len(w)):
            total += np.bitwise_count(planes[:, p] & planes[:, q]).astype(np.int64) * (w[p] * w[q])
    return total


def nearest(planes: np.ndarray, norm: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's nearest centroid, the first of equals, and the squared distance."""
    others = to_planes(centroids)
    distance = norm[:, None] - 2 * products(planes, others) + norms(others)[None, :]
    best = distance.argmin(axis=1)
    return best, distance[np.arange(len(best)), best]


def _whole(batch: pa.RecordBatch) -> tuple[pa.Array, np.ndarray]:
    """Ids and whole numbers of the rows that are kept."""
    own = batch.filter(pc.fill_null(pc.equal(pc.list_value_length(batch.column("vector")), SIZE), False))
    x = pc.list_flatten(own.column("vector")).to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, SIZE)
    finite = np.isfinite(x).all(axis=1)
    with np.errstate(over="ignore"):
        x = np.floor(SCALE * x[finite])
    if x.size and np.abs(x).max() >= _LARGEST:
        raise ValueError(f"a component beyond {_LARGEST} has distances beyond 64 bits")
    return own.column("id").filter(pa.array(finite)), x.astype(np.int64)


def bit_planes(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """``id``, ``planes`` and ``norm`` of the vectors that are kept."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, values = _whole(batch)
            planes = to_planes(values)
            data = pa.array([row.tobytes() for row in planes.astype("<u8", copy=False)], pa.binary())
            yield pa.RecordBatch.from_arrays([ids, data, pa.array(norms(planes))], ["id", "planes", "norm"])

    rows = vectors.select(F.col(id_column).cast("bigint").alias("id"),
                          F.col(vector_column).cast("array<double>").alias("vector"))
    return rows.mapInArrow(pack, PLANES)


def _by_width(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of a batch and their planes, for each number of planes."""
    sizes = pc.binary_length(batch.column("planes")).to_numpy(zero_copy_only=False)
    for size in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == size)
        data = b"".join(batch.column("planes").take(pa.array(at)).to_pylist())
        yield at, np.frombuffer(data, dtype="<u8").reshape(len(at), size // 8)


def _assigned(batch: pa.RecordBatch, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    cluster, distance = np.zeros((2, batch.num_rows), dtype=np.int64)
    norm = batch.column("norm").to_numpy()
    for at, planes in _by_width(batch):
        cluster[at], distance[at] = nearest(planes, norm[at], centroids)
    return cluster, distance


def cluster_sums(packed: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``cluster``, its ``n`` vectors and their ``sums``, a row for each task that has some."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = np.zeros(len(centroids), dtype=np.int64), np.zeros((len(centroids), SIZE), dtype=np.int64)
        for batch in batches:
            cluster, _ = _assigned(batch, centroids)
            n += np.bincount(cluster, minlength=len(n))
            for at, planes in _by_width(batch):
                for c in np.unique(cluster[at]).tolist():
                    sums[c] += bit_sums(planes[cluster[at] == c])
        own = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays(
            [pa.array(own.astype(np.int32)), pa.array(n[own]), pa.array(sums[own].tolist(), pa.list_(pa.int64()))],
            ["cluster", "n", "sums"])

    return packed.select("planes", "norm").mapInArrow(add, "cluster int, n bigint, sums array<bigint>")


def seeds(packed: DataFrame, k: int = K, seed: int = SEED) -> np.ndarray:
    """The components of the ``k`` vectors whose ids hash lowest."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    rows = packed.orderBy(order.asc_nulls_last(), "planes").limit(k).select("planes").collect()
    found = [bit_sums(np.frombuffer(r["planes"], dtype="<u8")[None, :]) for r in rows]
    return np.array(found, dtype=np.int64).reshape(-1, SIZE)


def moved(packed: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Centroids after one round; what reaches the driver is one row for each cluster."""
    totals = [F.sum(F.get("sums", F.lit(j))).alias(f"s{j}") for j in range(SIZE)]
    after = centroids.copy()
    for row in cluster_sums(packed, centroids).groupBy("cluster").agg(F.sum("n").alias("n"), *totals).collect():
        after[row["cluster"]] = [row[f"s{j}"] // row["n"] for j in range(SIZE)]
    return after


def assign(packed: DataFrame, centroids: np.ndarray) -> DataFrame:
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cluster, distance = _assigned(batch, centroids)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(cluster.astype(np.int32)), pa.array(distance)],
                                             ["vec_id", "cluster", "distance"])

    return packed.mapInArrow(find, "vec_id bigint, cluster int, distance bigint")


def digest(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, centroid.tolist())).encode()).hexdigest()


def clusters(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, seed: int = SEED, id_column: str = "vec_id",
             vector_column: str = "embedding") -> DataFrame:
    """Each kept vector's cluster after ``rounds`` rounds, and what the clusters amount to."""
    spark = vectors.sparkSession
    packed = cut_lineage(bit_planes(vectors, id_column, vector_column), "planes")
    centroids = seeds(packed, k, seed)
    if not len(centroids):
        return spark.createDataFrame([], RESULT)
    for _ in range(rounds):
        centroids = moved(packed, centroids)
    found = cut_lineage(assign(packed, centroids), "assigned")
    sums = {r["cluster"]: int(r["s"]) for r in found.groupBy("cluster").agg(
        F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    rows = [(c, s, sum(sums.values()), digest(centroids[c])) for c, s in sums.items()]
    about = spark.createDataFrame(rows, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    # One row for each cluster: k at most.
    return found.join(F.broadcast(about), "cluster").select(*(c.split()[0] for c in RESULT.split(", ")))


def op11_bitplane_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters(read_table(spark, sf_dir, "embeddings"))


def _sql() -> str:
    steps = [f"""kept AS (
        SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
        FROM embeddings
        WHERE len(embedding) = {SIZE} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {SIZE}),
    c0 AS (
        SELECT row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id), v) - 1 AS c, v FROM kept
        QUALIFY c < {K})"""]
    for i in range(ROUNDS + 1):
        steps.append(f"""a{i} AS (
        SELECT r, any_value(vec_id) AS vec_id, any_value(k.v) AS v, min(struct_pack(
            d := list_sum(list_transform(list_zip(k.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), c := c)) AS m
        FROM kept k, c{i} c GROUP BY r)""")
        if i < ROUNDS:
            steps.append(f"""c{i + 1} AS (
        SELECT c.c, coalesce(w.v, c.v) AS v FROM c{i} c LEFT JOIN (
            SELECT c, list(CAST(floor((s - ((s % n) + n) % n) / n) AS BIGINT) ORDER BY j) AS v FROM (
                SELECT c, j, sum(x) AS s, count(*) AS n FROM (
                    SELECT m.c AS c, unnest(v) AS x, generate_subscripts(v, 1) AS j FROM a{i}) GROUP BY c, j)
            GROUP BY c) w ON w.c = c.c)""")
    return f"""WITH {", ".join(steps)}
    SELECT vec_id, CAST(m.c AS INTEGER) AS cluster, CAST(m.d AS BIGINT) AS distance,
           CAST(sum(m.d) OVER (PARTITION BY m.c) AS BIGINT) AS cluster_inertia, CAST(sum(m.d) OVER () AS BIGINT) AS inertia,
           sha256(array_to_string(c.v, ',')) AS centroid_sha256
    FROM a{ROUNDS} a JOIN c{ROUNDS} c ON a.m.c = c.c"""


QUERIES = {"op11_bitplane_clusters": op11_bitplane_clusters}
ORACLES = {"op11_bitplane_clusters": _sql()}
