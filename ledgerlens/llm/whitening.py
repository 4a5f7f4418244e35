"""Embedding whitening with a weighted multiplicity covariance (operator 13).

Every vector becomes whole numbers x = floor(256 c), so that equal vectors are
found exactly. Rows with the same x are grouped; the group's number of rows
(``weights="count"``) or one (``weights="one"``) is its weight in the fit. With
n the sum of weights and S that of x, the covariance is V = sum w (x - S/n)
(x - S/n)' / n, centred before it is multiplied: tasks add up their own part as
one weighted matrix product and Spark adds the parts, d (d + 1) / 2 sums for
vectors of d components. The unit eigenvectors of V, by falling eigenvalue e,
are the components; (x - S/n) on a component over sqrt(e) is whitened. Each
distinct vector is whitened once and joined back to its rows.

One vector may hold a third of the rows: grouping combines within tasks first,
and vectors with more than a ``HOT``-th of all rows (fewer than ``HOT`` by
counting, so their broadcast is bounded) are joined apart from the others.

The driver receives d sums and d (d + 1) / 2 products, nothing by row.

Defined cases: vectors that are null, hold null or non-finite components, or
have another length than most vectors of the table take no part; a row without
an id is a row like others; repeated rows are rows each and weigh as said; a
component whose eigenvalue is not above ``LEAST`` of the trace is left out (all
are where there is one distinct vector), so an empty table has no result; a
deviation beyond a long is null; entries whose sums would leave a long are an
error; other columns are not read, so their names cannot clash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import check_columns, cut_lineage

HOT = 1000
LEAST = 1e-10


def whole_vectors(df: DataFrame, id_col: str, vec_col: str, scale: int = 256) -> tuple[DataFrame, int, int]:
    """(id and x of the rows that take part, their number, their length). x is
    an array of the narrowest integer type that holds every entry."""
    v = F.col("v")
    given = df.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("v")).where(
        v.isNotNull() & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))))
    rows = given.select("id", F.transform("v", lambda c: F.floor(c * F.lit(float(scale)))).alias("x")).where(
        F.size("x") > 0)
    largest = F.greatest(F.abs(F.array_max("x").cast("double")), F.abs(F.array_min("x").cast("double")))
    usual = (rows.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n"), F.max(largest).alias("top"))
             .orderBy(F.desc("n"), "d").first())
    if usual is None:
        return rows.where(F.lit(False)), 0, 0
    d, n, top = usual
    if top * n >= 2.0 ** 62:
        raise ValueError("entries are too large for exact sums")
    kind = "smallint" if top < 1 << 15 else "int" if top < 1 << 31 else "bigint"
    return rows.where(F.size("x") == d).withColumn("x", F.col("x").cast(f"array<{kind}>")), n, d


def _matrix(column, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def sums(df: DataFrame, col: str, d: int, exact: bool) -> tuple[int, list]:
    """Sum of the weights ``w`` and the weighted sums of each component."""
    kind = np.int64 if exact else np.float64

    def run(batches):
        n, total = 0, np.zeros(d, kind)
        for batch in batches:
            w = batch.column("w").to_numpy(zero_copy_only=False)
            n += int(w.sum())
            total += w.astype(kind) @ _matrix(batch.column(col), d).astype(kind)
        yield pa.RecordBatch.from_pydict({"dim": pa.array(range(-1, d), pa.int32()),
                                          "n": pa.array([n] + [0] * d, pa.int64()),
                                          "s": pa.array(np.concatenate([[0], total]).astype(kind))})

    s = F.sum(F.col("s").cast("decimal(38,0)")) if exact else F.sum("s")
    got = {r[0]: r for r in df.mapInArrow(run, f"dim int, n long, s {'long' if exact else 'double'}")
           .groupBy("dim").agg(F.sum("n"), s).collect()}
    return int(got[-1][1]), [int(got[i][2]) if exact else got[i][2] for i in range(d)]


def covariance(df: DataFrame, col: str, n: int, mean: np.ndarray) -> np.ndarray:
    """Weighted covariance with divisor n, centred first."""
    d = len(mean)
    i, j = np.triu_indices(d)

    def run(batches):
        total = np.zeros((d, d))
        for batch in batches:
            x = _matrix(batch.column(col), d).astype(np.float64) - mean
            w = batch.column("w").to_numpy(zero_copy_only=False).astype(np.float64)
            total += (x * w[:, None]).T @ x
        yield pa.RecordBatch.from_pydict({"i": pa.array(i.astype(np.int32)), "j": pa.array(j.astype(np.int32)),
                                          "v": pa.array(total[i, j])})

    out = np.zeros((d, d))
    for a, b, v in df.mapInArrow(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v")).collect():
        out[a, b] = out[b, a] = v / n
    return out


def components(v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues above LEAST of the trace, falling, and their
    unit eigenvectors as columns; the largest entry of each is positive."""
    values, vectors = np.linalg.eigh(v)
    keep = [c for c in range(len(values) - 1, -1, -1) if values[c] > LEAST * np.trace(v)][:k]
    vectors = vectors[:, keep]
    if keep:
        vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(axis=0), range(len(keep))])
    return values[keep], vectors


def _back(rows: DataFrame, made: DataFrame, n_rows: int) -> DataFrame:
    """Rows with what was made of their vector."""
    often = F.col("copies") * HOT > n_rows
    hot = made.where(often)
    if hot.isEmpty():
        return rows.join(made, "x")
    apart = rows.join(F.broadcast(hot), "x")
    rest = rows.join(F.broadcast(hot.select("x")), "x", "left_anti")
    return apart.unionByName(rest.join(made.where(~often), "x"))


def whiten(df: DataFrame, k: int = 4, id_col: str = "vec_id", vec_col: str = "embedding",
           weights: str = "one", scale: int = 256) -> DataFrame:
    """One row for each row that takes part and each of the first k components:
    ``id_col``, component (from 1), n (sum of weights), deviation (sum over
    dimensions of (n x - S)**2), whitened, explained (eigenvalue over trace),
    identity_error (largest absolute entry of the whitened vectors' covariance
    minus the identity)."""
    check_columns(df, id_col, vec_col)
    if weights not in ("one", "count"):
        raise ValueError("weights must be 'one' or 'count'")
    rows, n_rows, d = whole_vectors(df, id_col, vec_col, scale)
    empty = rows.sparkSession.createDataFrame([], df.select(F.col(id_col)).schema).selectExpr(
        f"`{id_col}`", "0 AS component", "0L AS n", "0L AS deviation", "0D AS whitened", "0D AS explained",
        "0D AS identity_error")
    if not n_rows:
        return empty
    distinct = cut_lineage(rows.groupBy("x").agg(F.count(F.lit(1)).alias("copies"))).withColumn(
        "w", F.lit(1).cast("long") if weights == "one" else F.col("copies"))
    n, s = sums(distinct, "x", d, exact=True)
    mean = np.array([x / n for x in s])
    v = covariance(distinct, "x", n, mean)
    values, vectors = components(v, k)
    if not len(values):
        return empty
    onto = vectors / np.sqrt(values)
    s_long = np.array(s, np.int64)
    s_square = sum(x * x for x in s)

    def run(batches):
        for batch in batches:
            x = _matrix(batch.column("x"), d).astype(np.int64)
            made = (x - mean) @ onto
            # (n x - S)^2 summed, in whole numbers of any size
            big = float(np.abs(x).max(initial=0)) * float(np.abs(s_long).max()) * d >= 2.0 ** 62
            a, b = (x.astype(object), s_long.astype(object)) if big else (x, s_long)
            squares = [n * n * int(q) - 2 * n * int(p) + s_square for q, p in zip((a * a).sum(axis=1), a @ b)]
            yield pa.RecordBatch.from_pydict({
                "x": batch.column("x"), "w": batch.column("w"), "copies": batch.column("copies"),
                "deviation": pa.array([q if q < 1 << 63 else None for q in squares], pa.int64()),
                "whitened": pa.array(list(made), pa.list_(pa.float64()))})

    ddl = f"x {distinct.schema['x'].dataType.simpleString()}, w long, copies long, deviation long, whitened array<double>"
    made = distinct.mapInArrow(run, ddl)
    _, t = sums(made, "whitened", len(values), exact=False)
    error = np.abs(covariance(made, "whitened", n, np.array(t) / n) - np.eye(len(values))).max()
    share = F.array(*[F.lit(float(e / np.trace(v))) for e in values])
    return (_back(rows, made.drop("w"), n_rows)
            .select(F.col("id").alias(id_col), "deviation", F.posexplode("whitened").alias("at", "whitened"))
            .select(id_col, (F.col("at") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"),
                    "deviation", "whitened", share[F.col("at")].alias("explained"),
                    F.lit(float(error)).alias("identity_error")))
