"""Approximate nearest neighbours by collision counting (operator 2).

Vectors lie on the unit sphere after division by the largest norm and one more
component that fills them up to length 1, so the largest inner product with a
query is the smallest distance from its direction. Each of ``m`` random
directions gives one array of projections, sorted. A query opens a window
around its own projection in every array (two binary searches); the window's
half width is the search radius, so a vector at that distance falls into a
window with probability 0.683. A vector collides with the query in an array if
its place there lies in the window. Vectors that collide in enough arrays
(``confidence`` standard deviations below 0.683 m) are verified with exact
scores. The radius grows (virtual rehashing: the same arrays, wider windows)
until k verified vectors lie within it: by a factor while fewer are verified,
then to the distance of the k-th of them. There is no cap on candidates. A
sample of the block only sets the first radius.

All rows are indexed, in blocks of bounded size. A block's rows and the queries
meet in one partition, sorted so that the block comes first: it is indexed once
and the queries stream through it in batches, so neither a task nor the driver
holds the table or the queries. The k best of every block are merged by a top-k
window. Every query visits every block (the contract's all queries against all
rows), so work is the product of both.

Defined cases: vectors that are null, zero, hold null or non-finite
components, or have another length than most vectors of the table, and rows
without an id, take no part; a candidate with the query's id is its own row
and is left out; query rows that repeat with id and vector are one query, equal
ids with different vectors are searched each; ties in score go to the smaller
id; repeated rows are candidates each; fewer than k candidates are all
returned; an empty table has no result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import check_columns, parts

P_HIT = 0.6826894921370859  # P(|N(0, 1)| <= 1)
SAMPLE = 1024


def valid_vectors(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    v = F.col(vec_col)
    good = df.select(F.col(id_col).cast("long").alias("id"), v.cast("array<double>").alias("v")).where(
        F.col("id").isNotNull() & F.col("v").isNotNull()
        & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists("v", lambda x: x != 0))
    usual = good.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    return good.where(F.size("v") == (usual[0] if usual else 0))


class Index:
    """Sorted projections of one block, and each vector's place in them."""

    def __init__(self, x: np.ndarray, longest: float, m: int, seed: int):
        self.x, self.m = x, m
        unit = x / longest
        rest = np.sqrt(np.maximum(0.0, 1 - (unit * unit).sum(axis=1)))
        self.unit = np.column_stack([unit, rest])
        self.directions = np.random.default_rng(seed).standard_normal((m, self.unit.shape[1]))
        projected = np.ascontiguousarray((self.unit @ self.directions.T).T)
        order = np.argsort(projected, axis=1)
        self.sorted = np.take_along_axis(projected, order, axis=1)
        self.place = np.empty((m, len(x)), np.uint16 if len(x) < 1 << 16 else np.uint32)
        np.put_along_axis(self.place, order, np.arange(len(x), dtype=self.place.dtype)[None, :], axis=1)

    def collisions(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """In how many arrays each vector lies in the window [low, high)."""
        kind = self.place.dtype
        inside = (self.place - low.astype(kind)[:, None]) < (high - low).astype(kind)[:, None]
        return inside.view(np.uint8).sum(axis=0, dtype=np.uint8 if self.m < 256 else np.uint32)

    def search(self, q: np.ndarray, longest: float, k: int, confidence: float, grow: float):
        """For each query: indices of the verified vectors that may be among
        its k nearest, at least all verified ones as near as the k-th; and how
        many were verified."""
        n, m = len(self.x), self.m
        length = np.sqrt((q * q).sum(axis=1))
        unit = np.column_stack([q / length[:, None], np.zeros(len(q))])
        centre = unit @ self.directions.T
        need = int(np.floor(m * P_HIT - confidence * np.sqrt(m * P_HIT * (1 - P_HIT))))
        rows = np.random.default_rng(0).permutation(n)[:SAMPLE]
        seen = np.sqrt(np.maximum(0.0, 2 - 2 * (unit @ self.unit[rows].T)))
        rank = min(len(rows) - 1, int(np.ceil(k * len(rows) / n)))
        first = np.maximum(np.partition(seen, rank, axis=1)[:, rank] * 0.94, 1e-3)
        low, high = np.empty((2, len(q), m), np.int64)

        def windows(at, radius):
            """The windows of these queries, one array at a time."""
            for j in range(m):
                low[at, j] = self.sorted[j].searchsorted(centre[at, j] - radius, "left")
                high[at, j] = self.sorted[j].searchsorted(centre[at, j] + radius, "right")

        radius, active = first.copy(), np.arange(len(q))
        score = [np.zeros(0)] * len(q)
        found = [np.zeros(0, np.int64)] * len(q)
        while len(active):
            windows(active, radius[active])
            on = []
            for i in active.tolist():
                over = self.collisions(low[i], high[i]) >= need
                over[found[i]] = False  # verified in an earlier round
                new = np.flatnonzero(over)
                found[i] = np.concatenate([found[i], new])
                score[i] = np.concatenate([score[i], self.x[new] @ q[i]])
                got, wider = len(found[i]), radius[i] * grow
                if got > k:
                    # one more than k, for the query's own row; its distance is
                    # wide enough, for the k-th can only come nearer
                    kth = np.partition(score[i], got - 1 - k)[got - 1 - k]
                    wider = np.sqrt(max(0.0, 2 - 2 * kth / (length[i] * longest)))
                if got < n and wider > radius[i]:
                    on.append(i)
                    radius[i] = wider
            active = np.array(on, np.int64)
        out = []
        for f, s in zip(found, score):
            if len(f) > k:
                kth = np.partition(s, len(s) - 1 - k)[len(s) - 1 - k]
                f = f[s >= kth - 1e-9 * max(1.0, abs(kth))]
            out.append(f)
        return out, [len(f) for f in found]


def exact_scores(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products in double precision, summed in order of components (equal
    vectors have equal scores)."""
    return np.cumsum(x * q, axis=1)[:, -1]


class _Candidates:
    """A block's rows as they come in, sorted by id. Of rows equal in id and
    vector no more than k can be in a result, so no more are kept."""

    def __init__(self, k: int):
        self.k, self.ids, self.rows = k, [], []

    def add(self, ids: np.ndarray, x: np.ndarray) -> None:
        if self.ids and len(ids) and ids[0] == self.ids[-1][-1]:
            ids, x = np.concatenate([self.ids.pop(), ids]), np.concatenate([self.rows.pop(), x])
        keep = np.ones(len(ids), bool)
        edges = np.flatnonzero(np.diff(ids, prepend=ids[:1] - 1, append=ids[-1:] + 1)) if len(ids) else []
        for a, b in zip(edges, edges[1:]):
            if b - a > self.k:
                _, which = np.unique(x[a:b], axis=0, return_inverse=True)
                order = np.argsort(which.ravel(), kind="stable")
                w = which.ravel()[order]
                nth = np.arange(b - a) - np.searchsorted(w, w)
                keep[a + order[nth >= self.k]] = False
        self.ids.append(ids[keep])
        self.rows.append(x[keep])

    def arrays(self):
        return np.concatenate(self.ids), np.concatenate(self.rows)


def nearest(df: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding",
            m: int = 192, confidence: float = 1.2, grow: float = 1.06, block_rows: int = 16384,
            query_rows: int = 512, seed: int = 3, counts: bool = False) -> DataFrame:
    """The k rows of ``df`` with the largest inner product for every query of
    ``queries`` (same columns): query_id, rank (from 1), vec_id, score. With
    ``counts`` instead one row for each query and block: query_id, n_rows of
    the block and n_verified of them."""
    check_columns(df, id_col, vec_col)
    spark = df.sparkSession
    base, asked = valid_vectors(df, id_col, vec_col), valid_vectors(queries, id_col, vec_col)
    n, longest = base.agg(F.count(F.lit(1)), F.sqrt(F.max(F.aggregate(
        "v", F.lit(0.0), lambda acc, x: acc + x * x)))).first()
    longest = longest or 1.0
    blocks = max(1, -(-n // block_rows), min(parts(spark), -(-n // 2048)))
    cand = base.select(F.pmod(F.xxhash64("id", "v"), F.lit(blocks)).cast("int").alias("block"),
                       F.lit(0).alias("kind"), "id", "v")
    asks = asked.distinct().select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"),
                                   F.lit(1).alias("kind"), "id", "v")
    both = (cand.unionAll(asks).repartitionById(blocks, F.col("block"))
            .sortWithinPartitions("block", "kind", "id"))

    def runs(batches):
        """(block, kind, ids, vectors) of the rows in order, cut by block, kind
        and ``query_rows``."""
        for batch in batches:
            block, kind, ids = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("block", "kind", "id"))
            x = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
            cuts = np.flatnonzero((np.diff(block) != 0) | (np.diff(kind) != 0)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(ids)]):
                for lo in range(a, b, query_rows):
                    hi = min(b, lo + query_rows)
                    yield block[a], kind[a], ids[lo:hi], x[lo:hi]

    def search(batches):
        at, held, index, ids = None, None, None, None
        for block, kind, own, x in runs(batches):
            if block != at:
                at, held, index = block, _Candidates(k), None
            if kind == 0:
                held.add(own, x)
                continue
            if index is None:
                if not held.ids:
                    continue
                ids, rows = held.arrays()
                held, index = _Candidates(k), Index(rows, longest, m, seed)
            best, verified = index.search(x, longest, k, confidence, grow)
            if counts:
                yield pa.RecordBatch.from_pydict({"query_id": pa.array(own), "n_rows": pa.array([len(ids)] * len(own)),
                                                  "n_verified": pa.array(verified, pa.int64())})
                continue
            out = {"query_id": [], "vec_id": [], "score": [], "q": []}
            for one, vector, found in zip(own, x, best):
                found = found[ids[found] != one]
                score = exact_scores(index.x[found], vector)
                order = np.lexsort((ids[found], -score))[:k]
                out["query_id"] += [one] * len(order)
                out["q"] += [_number(vector.tobytes())] * len(order)
                out["vec_id"] += ids[found][order].tolist()
                out["score"] += score[order].tolist()
            yield pa.RecordBatch.from_pydict({"query_id": pa.array(out["query_id"], pa.int64()),
                                              "vec_id": pa.array(out["vec_id"], pa.int64()),
                                              "score": pa.array(out["score"], pa.float64()),
                                              "q": pa.array(out["q"], pa.int64())})

    if counts:
        return both.mapInArrow(search, "query_id long, n_rows long, n_verified long")
    found = both.mapInArrow(search, "query_id long, vec_id long, score double, q long")
    order = W.partitionBy("query_id", "q").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def _number(vector: bytes) -> int:
    """A vector's 64-bit number, to tell queries of one id apart."""
    from xxhash import xxh64_intdigest
    return xxh64_intdigest(vector) - (1 << 63)
