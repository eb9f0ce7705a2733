"""Approximate nearest neighbours by largest inner product, with an adaptive dimension scan.

Vectors get one more coordinate that makes all of them as long as the longest;
then the nearest by distance has the largest inner product. An index of lists
(k-means centres, fitted on a sample of ``SAMPLE`` rows by hash) holds every
vector. A query probes the lists nearest to it. Their number is not fixed: for
``CALIBRATION`` queries (by hash) the exact neighbours are found among all
vectors, and so many lists are probed as hold the share ``RECALL`` of these.
A query whose lists don't hold k candidates probes further ones.

The lists nearest to a query are scanned first and give it a threshold, the
distance of its k-th nearest so far; the others return only what is nearer. In
a list, vectors and queries are turned by one random rotation and read in
blocks of ``STEP`` columns: after each block, a partial distance that is too
large for the threshold, by a hypothesis test with error parameter
``EPSILON``, abandons the candidate. Blocks are products of matrices while
many candidates are left, and sums over single pairs after that. Survivors are
scored exactly, in double precision on the original vectors.

Lists are cut into blocks of ``ROWS`` vectors and ``QUERIES`` queries, so a
list that holds a third of all vectors is many tasks.

Defined results: vectors that are null, zero, or hold null or non-finite
components take no part, nor do those without vec_id; each dimension is
searched by itself; of rows that repeat a vec_id divisible by the query step, the least
vector is the query, and all count as candidates of others but never of that
vec_id; ties go to the smaller vec_id; an empty table gives an empty result;
columns other than the id and the vector are ignored, whatever their names.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronogeo.session import durable, ship_package

K = 20
QUERY_STEP = 20
SAMPLE = 20_000
MAX_LISTS = 1024
CALIBRATION = 256
RECALL = 0.95
STEP = 16
EPSILON = 2.1
ROWS = 8192
QUERIES = 8192
#: Pairs of a query and a vector that are looked at together.
CELLS = 1 << 19
SEED = 11


def kmeans(x: np.ndarray, n: int, rounds: int = 8, seed: int = SEED) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), n, replace=False)].copy()
    for _ in range(rounds):
        own = nearest_centres(x, centres, 1)[:, 0]
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        counts = np.bincount(own, minlength=n)
        full = counts > 0
        centres[full] = sums[full] / counts[full, None]
    return centres


def nearest_centres(x: np.ndarray, centres: np.ndarray, k: int) -> np.ndarray:
    far = (centres**2).sum(axis=1)[None, :] - 2 * (x @ centres.T)
    return np.argsort(far, axis=1, kind="stable")[:, :k] if k > 1 else far.argmin(axis=1)[:, None]


def lengthened(x: np.ndarray, longest: float, query: bool) -> np.ndarray:
    """Vectors with the coordinate that evens out their lengths (0 for queries)."""
    extra = np.zeros(len(x)) if query else np.sqrt(np.maximum(longest - (x * x).sum(axis=1), 0))
    return np.column_stack([x, extra])


def rotation(d: int, seed: int = SEED) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def exact_scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of rows, added up column by column, so that equal vectors score alike."""
    out = np.zeros(len(q))
    for j in range(q.shape[1]):
        out += q[:, j] * x[:, j]
    return out


def _rotated(x: np.ndarray, turn: np.ndarray, longest: float, query: bool) -> np.ndarray:
    """Vectors, with lengths of 1 at most, lengthened and turned."""
    scale = np.linalg.norm(x, axis=1, keepdims=True) if query else math.sqrt(longest)
    return (lengthened(x / scale, 1.0, query) @ turn).astype(np.float32)


def _bound(t: int, d: int, epsilon: float) -> float:
    """What t of d columns may sum up to, as a share of the threshold."""
    return (t / d) * (1 + epsilon / math.sqrt(t)) ** 2 if t < d else 1.0


def _survivors(qr: np.ndarray, xr: np.ndarray, limit: np.ndarray, sure: np.ndarray | None, step: int, epsilon: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that no test abandons; sure are the first vectors' pairs that stay at any distance."""
    d = xr.shape[1]
    slack = np.float32(1e-4)
    far, at = np.zeros((len(qr), len(xr)), np.float32), 0
    while at < d:
        to = min(d, at + step)
        q, x = qr[:, at:to], xr[:, at:to]
        far += (q * q).sum(axis=1)[:, None] + (x * x).sum(axis=1)[None, :] - 2 * (q @ x.T)
        live = far <= (limit * _bound(to, d, epsilon) + slack)[:, None]
        if sure is not None:
            live[:, : sure.shape[1]] |= sure
        at = to
        if np.count_nonzero(live) * 12 < live.size:
            break
        far[~live] = np.inf
    qi, xi = np.nonzero(live)
    far = far[qi, xi]
    kept = sure[qi, np.minimum(xi, sure.shape[1] - 1)] & (xi < sure.shape[1]) if sure is not None else np.zeros(len(qi), bool)
    while at < d and len(qi):
        to = min(d, at + step)
        gap = qr[qi, at:to] - xr[xi, at:to]
        far += np.einsum("ij,ij->i", gap, gap)
        live = (far <= limit[qi] * _bound(to, d, epsilon) + slack) | kept
        qi, xi, far, kept, at = qi[live], xi[live], far[live], kept[live], to
    return qi, xi


def scan(q_ids: np.ndarray, q: np.ndarray, x_ids: np.ndarray, x: np.ndarray, turn: np.ndarray, longest: float, k: int, least: np.ndarray | None = None, step: int = STEP, epsilon: float = EPSILON) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query id, vector id, score) of the k nearest of one block of vectors, for each query.

    least holds scores that the queries' k-th nearest already have; without them, some vectors of the block give the threshold.
    """
    out = ([], [], [])
    xr = _rotated(x, turn, longest, False)
    some = slice(0, max(8 * k, 256))
    size = max(64, CELLS // max(1, len(x)))
    for at in range(0, len(q), size):
        ids, part = q_ids[at : at + size], q[at : at + size]
        qr = _rotated(part, turn, longest, True)
        if least is None:
            # A threshold for each query: the distance of its k-th nearest among some vectors.
            first = 2 - 2 * (qr @ xr[some].T)
            first[ids[:, None] == x_ids[None, some]] = np.inf
            limit = np.partition(first, k - 1, axis=1)[:, k - 1] if first.shape[1] >= k else np.full(len(part), np.inf, np.float32)
            # Those that give the threshold are never abandoned, so a block yields k rows wherever it holds as many.
            sure = first <= limit[:, None]
        else:
            limit, sure = (2 - 2 * least[at : at + size] / (np.linalg.norm(part, axis=1) * math.sqrt(longest))).astype(np.float32), None
        qi, xi = _survivors(qr, xr, limit, sure, step, epsilon)
        other = ids[qi] != x_ids[xi]
        qi, xi = qi[other], xi[other]
        score = exact_scores(part[qi], x[xi])
        order = np.lexsort((x_ids[xi], -score, qi))
        qi, xi, score = qi[order], xi[order], score[order]
        begin = np.searchsorted(qi, np.arange(len(part)))
        top = np.arange(len(qi)) - begin[qi] < k
        if least is not None:
            top &= score >= least[at : at + size][qi]
        for column, value in zip(out, (ids[qi[top]], x_ids[xi[top]], score[top])):
            column.append(value)
    return tuple(np.concatenate(c) for c in out)


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)


def usable(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """vec_id (long) and v (array of double) of the vectors that take part."""
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return rows.filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & finite & F.exists("v", lambda c: c != 0))


def nearest(vectors: DataFrame, *, vec_id: str = "vec_id", embedding: str = "embedding", k: int = K, query_step: int = QUERY_STEP, recall: float = RECALL) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest found for each query."""
    spark = vectors.sparkSession
    ship_package(spark)
    rows = usable(vectors, vec_id, embedding)
    square = F.aggregate("v", F.lit(0.0), lambda a, c: a + c * c)
    asks = F.count_if(F.col("vec_id") % query_step == 0)
    stats = rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n"), F.max(square).alias("longest"), asks.alias("asks")).filter("n > 1 AND asks > 0").collect()
    if not stats:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    queries = durable(rows.filter(F.col("vec_id") % query_step == 0).groupBy("vec_id").agg(F.min("v").alias("v"), F.count(F.lit(1)).alias("own")))
    of = lambda x, d: x.filter(F.size("v") == d)
    return reduce(DataFrame.unionByName, [_nearest_alike(of(rows, s["d"]), of(queries, s["d"]), s["n"], s["longest"], k, recall) for s in stats])


def probes_for(listed: DataFrame, queries: DataFrame, centres: np.ndarray, longest: float, k: int, recall: float) -> int:
    """The number of lists that hold the share recall of the exact neighbours of CALIBRATION queries."""
    spark = listed.sparkSession
    some = queries.orderBy(F.xxhash64("vec_id"), "vec_id").limit(CALIBRATION).select("vec_id", "v").toArrow()
    if recall >= 1 or not some.num_rows:
        return len(centres)
    asked = spark.sparkContext.broadcast((some["vec_id"].to_numpy(), _matrix(some["v"])))

    def best(batches):
        ids, q = asked.value
        score, lists = np.full((len(ids), k), -np.inf), np.full((len(ids), k), -1, np.int64)
        for batch in batches:
            if batch.num_rows:
                near = q @ _matrix(batch.column(1)).T
                near[ids[:, None] == batch.column(0).to_numpy()[None, :]] = -np.inf
                score = np.hstack([score, near])
                lists = np.hstack([lists, np.broadcast_to(batch.column(2).to_numpy().astype(np.int64), near.shape)])
                top = np.argpartition(-score, k - 1, axis=1)[:, :k]
                score, lists = np.take_along_axis(score, top, 1), np.take_along_axis(lists, top, 1)
        of, _ = found = np.nonzero(np.isfinite(score))
        yield pa.RecordBatch.from_arrays([pa.array(of), pa.array(lists[found]), pa.array(score[found])], names=["query", "list", "score"])

    found = listed.select("vec_id", "v", "list").mapInArrow(best, "query bigint, list bigint, score double")
    nth = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "list"))
    found = found.withColumn("nth", nth).filter(F.col("nth") <= k).select("query", "list").toArrow()  # CALIBRATION * k rows at most
    order = nearest_centres(lengthened(asked.value[1], longest, True), centres, len(centres)).reshape(some.num_rows, -1)
    place = np.argsort(order, axis=1)[found["query"].to_numpy(), found["list"].to_numpy()]
    return int(np.quantile(place, recall, method="higher")) + 1 if len(place) else len(centres)


def _blocks(listed: DataFrame, asked: DataFrame, sizes: dict[int, int], turn, longest: float, k: int) -> DataFrame:
    """query_id, vec_id, score: each list scanned for the queries that name it; asked has vec_id, v, lists, least (null: none)."""
    spark = listed.sparkSession
    wanted = {r["list"]: r["count"] for r in asked.select(F.explode("lists").alias("list")).groupBy("list").count().collect()}
    parts = spark.createDataFrame([(i, max(1, -(-m // ROWS)), max(1, -(-wanted.get(i, 0) // QUERIES))) for i, m in sizes.items()], "p_list int, n_rows int, n_queries int")
    parts = F.broadcast(parts)  # MAX_LISTS rows at most
    left = listed.join(parts, F.col("list") == F.col("p_list")).withColumn("part", F.pmod(F.xxhash64("vec_id", "v"), F.col("n_rows")).cast("int"))
    left = left.select("list", "part", F.explode(F.sequence(F.lit(0), F.col("n_queries") - 1)).alias("q_part"), "vec_id", "v")
    right = asked.select("vec_id", "v", "least", F.explode("lists").alias("list")).join(parts, F.col("list") == F.col("p_list")).withColumn("q_part", F.pmod(F.xxhash64("vec_id"), F.col("n_queries")).cast("int"))
    right = right.select("list", F.explode(F.sequence(F.lit(0), F.col("n_rows") - 1)).alias("part"), "q_part", "vec_id", "v", "least")

    def search(x: pa.Table, q: pa.Table) -> pa.Table:
        from chronogeo.llm.adaptive_ann import _matrix, scan

        names = ["query_id", "vec_id", "score"]
        if not x.num_rows or not q.num_rows:
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())], names=names)
        least = q["least"].to_numpy() if not q["least"].null_count else None
        found = scan(q["vec_id"].to_numpy(), _matrix(q["v"]), x["vec_id"].to_numpy(), _matrix(x["v"]), turn.value, longest, k, least)
        return pa.table([pa.array(c) for c in found], names=names)

    return left.groupBy("list", "part", "q_part").cogroup(right.groupBy("list", "part", "q_part")).applyInArrow(search, "query_id bigint, vec_id bigint, score double")


def _nearest_alike(rows: DataFrame, queries: DataFrame, n: int, longest: float, k: int, recall: float) -> DataFrame:
    """nearest() for n vectors and queries of one dimension."""
    spark = rows.sparkSession
    sample = _matrix(rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("v").toArrow()["v"])
    n_lists = max(1, min(MAX_LISTS, len(sample), 2 * math.isqrt(n)))
    centres = spark.sparkContext.broadcast(kmeans(lengthened(sample, longest, False), n_lists))
    turn = spark.sparkContext.broadcast(rotation(sample.shape[1] + 1))

    def assign(batches):
        from chronogeo.llm.adaptive_ann import _matrix, lengthened, nearest_centres

        for batch in batches:
            if batch.num_rows:
                own = nearest_centres(lengthened(_matrix(batch.column(1)), longest, False), centres.value, 1)[:, 0]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(own.astype(np.int32))], names=["vec_id", "v", "list"])

    listed = durable(rows.mapInArrow(assign, "vec_id bigint, v array<double>, list int"))
    # At most MAX_LISTS rows each.
    sizes = {r["list"]: r["count"] for r in listed.groupBy("list").count().collect()}
    held = np.array([sizes.get(i, 0) for i in range(n_lists)])
    n_probes = probes_for(listed, queries, centres.value, longest, k, recall)

    def probe(batches):
        from chronogeo.llm.adaptive_ann import _matrix, lengthened, nearest_centres

        for batch in batches:
            if batch.num_rows:
                lists = nearest_centres(lengthened(_matrix(batch.column(1)), longest, True), centres.value, n_lists).reshape(batch.num_rows, -1)
                # Lists in order of distance before the one with which k candidates are reached, rows of the query's vec_id left out.
                short = (np.cumsum(held[lists], axis=1) < k + batch.column(2).to_numpy()[:, None]).sum(axis=1)
                near = np.maximum(-(-n_probes // 16), short + 1).tolist()
                lists = lists.astype(np.int32).tolist()
                columns = [[row[:m] for row, m in zip(lists, near)], [row[m:n_probes] for row, m in zip(lists, near)]]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, pa.list_(pa.int32())) for c in columns)], names=["vec_id", "v", "near", "more"])

    def ranked(found: DataFrame) -> DataFrame:
        nth = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        return found.withColumn("rank", nth).filter(F.col("rank") <= k)

    asked = durable(queries.mapInArrow(probe, "vec_id bigint, v array<double>, near array<int>, more array<int>"))
    none = F.lit(None).cast("double").alias("least")
    begun = durable(ranked(_blocks(listed, asked.select("vec_id", "v", F.col("near").alias("lists"), none), sizes, turn, longest, k)))
    if n_probes > 1:
        # A query with fewer than k rows so far has probed every list.
        least = begun.filter(F.col("rank") == k).select(F.col("query_id").alias("q_id"), F.col("score").alias("least"))
        rest = durable(asked.filter(F.size("more") > 0).join(least, F.col("vec_id") == F.col("q_id")).select("vec_id", "v", F.col("more").alias("lists"), "least"))
        begun = ranked(begun.drop("rank").unionByName(_blocks(listed, rest, sizes, turn, longest, k)))
    return begun.select("query_id", "rank", "vec_id", "score")
