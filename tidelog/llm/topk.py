"""Operator 5: exact top-k inner product search by a pivot-distance index.

Each component x becomes floor(256 x). With one more component that lifts every vector to the largest norm M, a larger
inner product is a smaller distance: d^2 = 2 M^2 - 2 q.v. Vectors are keyed by their nearest pivot and by the distance to
it. A query first searches its own pivot's vectors, which bounds its k-th distance; then it visits the other pivots
whose annuli that bound can reach, |d(q,p) - d(v,p)| <= d(q,v), in sorted annuli, and stops in each where the
triangle inequality says that nothing closer can follow. Scores are integers, computed exactly.

Pivots are picked farthest first from SAMPLE vectors, a documented bound, more for larger tables (PIVOTS to
MOST_PIVOTS); all vectors are indexed, and the search is exact for any pivots. A pivot's vectors are dealt into parts
of about PART_ROWS and its queries into blocks of about QUERY_ROWS, and each part meets each block in a task of its own.
Copies of a vector are searched as one row with its k + 1 smallest ids; equal queries are searched once.

Defined cases: vectors that are null or hold null or non-finite components take no part, nor do those without id; of
finite components none is too large: integers beyond 2^62 and scores beyond a long's range stand at that bound; a vector is
compared with vectors of its own length; rows that repeat id and vector count once; ties go to the smaller id; an empty
table gives an empty table.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelog.llm.common import bounded_batches, record_batch, stored, tidy

SCALE, SAMPLE, PIVOTS, MOST_PIVOTS, PART_ROWS, QUERY_ROWS, ANNULUS_ROWS = 256, 2048, 32, 512, 1 << 15, 1 << 13, 512
LARGEST, MOST_SCORE = float(1 << 62), (1 << 63) - 1


def integer_vectors(rows: DataFrame) -> DataFrame:
    """vec_id and code: the vector's integers as little-endian 64-bit binary, each pair once."""
    bounded_batches(rows.sparkSession)
    x = F.transform("embedding", lambda x: x.cast("double"))
    ok = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.forall("embedding", lambda x: F.coalesce(F.abs(x.cast("double")) < F.lit(float("inf")), F.lit(False)))
    ints = rows.filter(ok).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda y: F.floor(F.greatest(F.least(y * SCALE, F.lit(LARGEST)), F.lit(-LARGEST)))).alias("v"))
    out = pa.schema([("vec_id", pa.int64()), ("code", pa.binary())])

    def pack(batches):
        for batch in batches:
            v = batch.column("v")
            flat, n = v.flatten().to_numpy().astype("<i8"), np.cumsum([0, *pa.compute.list_value_length(v).to_pylist()])
            yield record_batch(out, [batch.column("vec_id"), [flat[a:b].tobytes() for a, b in zip(n, n[1:])]])

    return ints.mapInArrow(tidy(pack), "vec_id long, code binary").dropDuplicates(["code", "vec_id"])


def matrix(codes) -> np.ndarray:
    """Rows of integers from codes of one length."""
    return np.frombuffer(b"".join(codes), "<i8").reshape(len(codes), -1)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products, exact: in doubles where every sum stays below 2^53, in 64 bits below 2^63, else in whole numbers of any size."""
    most = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if most < 1 << 53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    if most < 1 << 63:
        return a @ b.T
    return np.clip(a.astype(object) @ b.T.astype(object), -MOST_SCORE, MOST_SCORE).astype(np.int64)


def squares(v: np.ndarray) -> np.ndarray:
    return (v.astype(np.float64) ** 2).sum(1)


def pick_pivots(codes: list[bytes], most: int) -> list[bytes]:
    """Farthest first among the sample; equal vectors are picked once."""
    v = matrix(codes).astype(np.float64)
    found, far = [0], ((v - v[0]) ** 2).sum(1)
    while len(found) < min(most, len(v)) and far.max() > 0:
        found.append(int(far.argmax()))
        far = np.minimum(far, ((v - v[found[-1]]) ** 2).sum(1))
    return [codes[i] for i in found]


class Space:
    """Distances to the pivots among lifted vectors of one length. Doubles: SLACK covers what they round."""

    def __init__(self, pivots: list[bytes], longest: float):
        self.p = matrix(pivots)
        self.longest = longest
        self.lift = np.sqrt(np.maximum(self.longest - squares(self.p), 0))

    def distances(self, v: np.ndarray) -> np.ndarray:
        lift = np.sqrt(np.maximum(self.longest - squares(v), 0))
        inner = v.astype(np.float64) @ self.p.T.astype(np.float64) + lift[:, None] * self.lift
        return np.sqrt(np.maximum(2 * self.longest - 2 * inner, 0))

    def reach(self, score: np.ndarray) -> np.ndarray:
        """The distance of a score, a little more for rounding."""
        found = np.sqrt(np.maximum(2 * self.longest - 2 * score.astype(np.float64), 0)) + slack(self.longest)
        return np.where(score <= -MOST_SCORE, np.inf, found)


def slack(longest: float) -> float:
    """Rounding moves a squared distance by 1e-7 of the largest norm's square at most, a distance by the root of that."""
    return 1e-3 * max(1.0, math.sqrt(longest))


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best, ties to the smaller id."""
    if len(scores) > 4 * k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        keep = np.flatnonzero(scores >= least)
        return keep[np.lexsort((ids[keep], -scores[keep]))[:k]]
    return np.lexsort((ids, -scores))[:k]


def search_part(vectors: pd.DataFrame, queries: pd.DataFrame, space: Space, k: int) -> pd.DataFrame:
    """vectors: ids (lists), code, dist to this pivot. queries: qid, code, dist to this pivot, bound (the k-th score so far or null)."""
    empty = pd.DataFrame({"qid": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="int64")})
    if not len(vectors) or not len(queries):
        return empty
    vectors = vectors.sort_values("dist", kind="stable")
    v, q = matrix(vectors["code"].tolist()), matrix(queries["code"].tolist())
    dist, own = vectors["dist"].to_numpy(), queries["dist"].to_numpy()
    lists = vectors["ids"].tolist()
    floor = np.where(queries["bound"].isna(), np.iinfo(np.int64).min, queries["bound"].fillna(0)).astype(np.int64)
    open_ = queries["bound"].isna().to_numpy()
    edges = list(range(0, len(v), ANNULUS_ROWS))
    low, high = np.array([dist[a] for a in edges]), np.array([dist[min(a + ANNULUS_ROWS, len(v)) - 1] for a in edges])
    bounds = np.maximum(0, np.maximum(low - own[:, None], own[:, None] - high))
    got: list[list[tuple[int, int]]] = [[] for _ in range(len(q))]
    order = np.argsort(bounds, 1, kind="stable")
    reach = np.where(open_, np.inf, space.reach(np.where(open_, 0, floor)))
    alive = np.arange(len(q))
    for step in range(len(edges)):  # each query's annuli, nearest first
        at = order[alive, step]
        alive = alive[bounds[alive, at] <= reach[alive]]
        if not len(alive):
            break
        at = order[alive, step]
        for cell in np.unique(at):
            mine = alive[at == cell]
            a = edges[cell]
            scores = products(q[mine], v[a : a + ANNULUS_ROWS])
            for row, i in zip(scores, mine):
                near = np.flatnonzero(row >= floor[i])
                if len(near):
                    pairs = got[i] + [(-int(row[j]), int(x)) for j in near[np.argsort(-row[near], kind="stable")][: 4 * k] for x in lists[a + j]] if len(near) <= k else got[i] + _top(row, near, lists, a, k)
                    got[i] = sorted(set(pairs))[:k]
                    if len(got[i]) == k:
                        floor[i] = max(floor[i], -got[i][-1][0])
                        reach[i] = space.reach(np.array([floor[i]]))[0]
    qid = queries["qid"].to_numpy()
    rows = [(qid[i], x, -s) for i, pairs in enumerate(got) for s, x in pairs]
    return pd.DataFrame(rows, columns=["qid", "vec_id", "score"]) if rows else empty


def _top(row: np.ndarray, near: np.ndarray, lists: list, a: int, k: int) -> list[tuple[int, int]]:
    """Of many vectors the k best by score and smallest id."""
    smallest = np.array([lists[a + j][0] for j in near])
    return [(-int(row[j]), int(x)) for j in near[best(row[near], smallest, k)] for x in lists[a + j]]


def top_k(rows: DataFrame, is_query, k: int) -> DataFrame:
    """query_id, rank, vec_id, score. is_query: a condition on vec_id."""
    spark = rows.sparkSession
    vectors = stored(integer_vectors(rows), "vectors")
    w = Window.partitionBy("code").orderBy("vec_id")
    copies = vectors.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= k + 1)
    distinct = stored(copies.groupBy("code").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")), "distinct")
    queries = vectors.filter(is_query)
    asked = queries.groupBy("code").agg(F.min("vec_id").alias("qid"))
    dims = [r[0] for r in distinct.select(F.octet_length("code")).distinct().collect()]
    spaces = {}
    out = spark.createDataFrame([], "qid long, vec_id long, score long")
    for dim in dims:  # one, unless vectors differ in length
        of_dim = distinct.filter(F.octet_length("code") == dim)
        sample = [bytes(r["code"]) for r in of_dim.orderBy(F.xxhash64("code"), "code").limit(SAMPLE).collect()]
        most = max(PIVOTS, min(MOST_PIVOTS, math.isqrt(of_dim.count()) // 16))
        spaces[dim] = (pick_pivots(sample, most) if dim else [b""], _longest(of_dim))
        out = out.union(_search(of_dim, asked.filter(F.octet_length("code") == dim), spaces[dim], k + 1))
    found = out.dropDuplicates(["qid", "vec_id", "score"])
    top = found.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "vec_id"))).filter(F.col("rank") <= k + 1)
    lists = top.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))).alias("found")).join(asked, "qid").select("code", "found")
    own = queries.select(F.col("vec_id").alias("query_id"), "code").join(lists, "code")
    kept = own.select("query_id", F.slice(F.filter("found", lambda x: x["vec_id"] != F.col("query_id")), 1, k).alias("found"))
    kept = kept.select("query_id", F.posexplode("found").alias("pos", "x"))
    return kept.select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), (-F.col("x.s")).alias("score"))


def _longest(of_dim: DataFrame) -> float:
    """The largest square of a norm, rounded up."""

    def norm(batches):
        for batch in batches:
            v = matrix([x or b"" for x in batch.column("code").to_pylist()])
            yield pa.RecordBatch.from_arrays([pa.array([float(squares(v).max(initial=0)) * (1 + 1e-12)], pa.float64())], names=["n"])

    return of_dim.select("code").mapInArrow(tidy(norm), "n double").agg(F.coalesce(F.max("n"), F.lit(0.0))).first()[0]


def _search(of_dim: DataFrame, asked: DataFrame, of_space: tuple, k: int) -> DataFrame:
    shared = of_dim.sparkSession.sparkContext.broadcast(of_space)

    def measured(batches, every: bool):
        """Adds the pivot and the distance: the nearest, or a row for every pivot that an annulus of may be near."""
        space = Space(*shared.value)
        for batch in batches:
            d = space.distances(matrix(batch.column("code").to_pylist())) if batch.num_rows else np.zeros((0, 1))
            near = d.argmin(1)
            if not every:
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near, pa.int32()), pa.array(d.min(1), pa.float64())], names=[*batch.schema.names, "pivot", "dist"])
            else:
                n, p = d.shape
                repeat = batch.take(pa.array(np.repeat(np.arange(n), p)))
                yield pa.RecordBatch.from_arrays([*repeat.columns, pa.array(np.tile(np.arange(p), n), pa.int32()), pa.array(d.ravel(), pa.float64()), pa.array((np.arange(p) == near[:, None]).ravel())], names=[*batch.schema.names, "pivot", "dist", "own"])

    index = stored(of_dim.mapInArrow(tidy(lambda b: measured(b, False)), "code binary, ids array<long>, pivot int, dist double"), "index")
    ranges = index.groupBy("pivot").agg(F.count("*").alias("n"), F.min("dist").alias("low"), F.max("dist").alias("high"))
    ranges = F.broadcast(ranges.select("pivot", F.ceil(F.col("n") / PART_ROWS).cast("int").alias("parts"), "low", "high"))  # PIVOTS rows at most
    dealt = index.join(ranges.select("pivot", "parts"), "pivot").withColumn("part", F.pmod(F.xxhash64("code"), F.col("parts")).cast("int"))
    measure = tidy(lambda b: measured(b, True))
    visits = stored(asked.mapInArrow(measure, "code binary, qid long, pivot int, dist double, own boolean"), "visits").join(ranges, "pivot")

    def run(visits: DataFrame) -> DataFrame:
        blocks = F.broadcast(visits.groupBy("pivot").agg(F.ceil(F.count("*") / QUERY_ROWS).cast("int").alias("blocks")))  # PIVOTS rows at most
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        spread = visits.join(blocks, "pivot").withColumn("part", every("parts")).withColumn("block", F.pmod(F.xxhash64("qid"), F.col("blocks")).cast("int"))
        spread = spread.select("pivot", "part", "block", "qid", "code", "dist", "bound")
        held = dealt.join(blocks, "pivot").withColumn("block", every("blocks")).select("pivot", "part", "block", "code", "ids", "dist")
        search = lambda key, v, q: search_part(v, q, Space(*shared.value), k)
        return held.groupBy("pivot", "part", "block").cogroup(spread.groupBy("pivot", "part", "block")).applyInPandas(search, "qid long, vec_id long, score long")

    first = stored(run(visits.filter("own").withColumn("bound", F.lit(None).cast("long"))), "first")
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "vec_id"))
    bound = first.withColumn("r", rank).filter(F.col("r") == k).select("qid", F.col("score").alias("bound"))
    longest = float(of_space[1])
    far = F.greatest(F.lit(0.0), F.col("low") - F.col("dist"), F.col("dist") - F.col("high"))
    reach = F.sqrt(F.greatest(F.lit(2 * longest) - 2 * F.col("bound").cast("double"), F.lit(0.0))) + F.lit(slack(longest))
    rest = visits.filter("not own").join(bound, "qid", "left").filter(F.col("bound").isNull() | (F.col("bound") <= -MOST_SCORE) | (far <= reach))
    return first.union(run(rest))
