"""SimHash near-duplicates by vantage-point trees (operator 5).

Fingerprints of equal value are one point. Points within ``bits`` bits of each
other are linked, and linked points form components.

Random 64-bit fingerprints all lie about 32 bits from any vantage point, so
with a search radius of 4 a tree over whole fingerprints prunes little (each
level sends about three quarters of the points to both sides). The trees here
therefore measure the Hamming distance within one of three segments of the
fingerprint: of two points at most 4 bits apart, some segment differs in at
most 4 // 3 = 1 bit. There is one tree for each segment, searched with radius
1, so the triangle bounds prune well and the union of the three searches is
exact.

The top levels of a tree are fitted on a bounded sample of the points (four for
each shard wanted, ``SAMPLE_POINTS`` to ``MOST_SAMPLED``) and only route: every point has one home shard in each
tree and also visits the shards whose region its ball overlaps. A shard is
searched by a tree of its own, whose leaves compare whole fingerprints. A
shard reports for each point the smallest point it is connected with there
(at most one link a visit, never all pairs); components come from repeated
joins on these links, with a checkpoint each round.

Defined cases: a null or empty text has fingerprint zero and is linked like
any other; a text with fewer words than a shingle has one shingle of all its
words; ties (exactly half) give bit 0; repeated rows come back each; rows
without a doc_id take part, and ``component_id`` is the smallest doc_id that is
there (null if none); extra columns pass through ``fingerprints``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import bounded_batches, check_columns, cut_lineage, schema_with, slices, text_bytes, with_columns

SEED = 42
SEGMENTS = ((0, 22), (22, 43), (43, 64))  # bits from, to
SAMPLE_POINTS, MOST_SAMPLED = 4096, 1 << 20
SHARD_POINTS = 8192
LEAF_CELLS = 1 << 18
HOT = 1000
FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: bytes, words: int = 4) -> int:
    """64-bit SimHash of the ``words``-word shingles (repeats count): a bit is
    1 if more than half of the shingles' XXH64 values have it."""
    from xxhash import xxh64_intdigest
    tokens = text.lower().split()
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    if len(tokens) <= words:
        return xxh64_intdigest(joined, SEED)
    ends = np.cumsum([len(t) + 1 for t in tokens])
    starts = [0, *ends[:-words].tolist()]
    stops = (ends[words - 1:] - 1).tolist()
    hashes = np.array([xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts, stops)], "<u8")
    votes = np.zeros(64, np.int64)
    for lo in range(0, len(hashes), 1 << 16):
        part = hashes[lo:lo + (1 << 16)]
        votes += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    on = 2 * votes > len(hashes)
    return int(np.packbits(on, bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, text_col: str = "text", words: int = 4) -> DataFrame:
    """Replaces the text by ``fp``: its fingerprint's 64 bits as a long."""
    check_columns(df, text_col)
    bounded_batches(df.sparkSession)

    def run(batches):
        for whole in batches:
            for batch in slices(whole, text_col):
                made = [fingerprint(t, words) for t in text_bytes(batch.column(text_col))]
                fp = np.array(made, np.uint64).view(np.int64)
                yield with_columns(batch.drop_columns([text_col]), {"fp": pa.array(fp)})

    return df.mapInArrow(run, schema_with(df, "fp long", (text_col,)))


def _mask(segment: tuple[int, int]) -> np.uint64:
    return np.uint64(sum(1 << b for b in range(*segment)))


def _split(points: np.ndarray, mask: np.uint64, rng: np.random.Generator):
    """A vantage point and the radius that halves the points best, or None if
    all points are at one distance from every vantage point tried."""
    best = None
    for v in points[rng.integers(0, len(points), 8)]:
        d = np.bitwise_count((points ^ v) & mask)
        counts = np.bincount(d)
        inside = np.cumsum(counts)[:-1]
        if len(inside):
            mu = int(np.abs(inside - len(points) / 2).argmin())
            share = min(inside[mu], len(points) - inside[mu])
            if share and (best is None or share > best[0]):
                best = (share, v, mu)
    return best and best[1:]


def grow(points: np.ndarray, mask: np.uint64, levels: int, rng: np.random.Generator):
    """Routing tree: (vantage, radius, inside, outside) or None for a shard."""
    split = _split(points, mask, rng) if levels and len(points) > 1 else None
    if split is None:
        return None
    v, mu = split
    near = np.bitwise_count((points ^ v) & mask) <= mu
    return (v, mu, grow(points[near], mask, levels - 1, rng), grow(points[~near], mask, levels - 1, rng))


def route(tree, points: np.ndarray, mask: np.uint64, radius: int):
    """(shard path, indices, at home) for each shard of the tree: points whose
    region it is, and visitors whose ball of ``radius`` overlaps the region."""
    todo = [(tree, "", np.arange(len(points)), np.ones(len(points), bool))]
    while todo:
        node, path, idx, home = todo.pop()
        if not len(idx):
            continue
        if node is None:
            yield path, idx, home
            continue
        v, mu, near, far = node
        d = np.bitwise_count((points[idx] ^ v) & mask).astype(np.int64)
        a, b = d <= mu + radius, d > mu - radius
        todo.append((near, path + "0", idx[a], home[a] & (d[a] <= mu)))
        todo.append((far, path + "1", idx[b], home[b] & (d[b] > mu)))


def shard_links(homes: np.ndarray, all_points: np.ndarray, mask: np.uint64, radius: int,
                bits: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Links between home points and any points of a shard: (point, smaller
    point it is connected with). Homes and visitors are pruned by a
    vantage-point tree; a region that its segment cannot halve any more is
    halved by whole fingerprints with radius ``bits``."""
    out_a, out_b = [], []
    todo = [(homes, all_points, mask, radius)]
    while todo:
        h, y, m, r = todo.pop()
        if not len(h) or not len(y):
            continue
        if len(h) * len(y) > LEAF_CELLS:
            split = _split(h, m, rng)
            if split is None and m != FULL:
                todo.append((h, y, FULL, bits))
                continue
            if split is not None:
                v, mu = split
                dh = np.bitwise_count((h ^ v) & m).astype(np.int64)
                dy = np.bitwise_count((y ^ v) & m).astype(np.int64)
                todo.append((h[dh <= mu], y[dy <= mu + r], m, r))
                todo.append((h[dh > mu], y[dy > mu - r], m, r))
                continue
        for lo in range(0, len(y), step := max(1, LEAF_CELLS // len(h))):
            part = y[lo:lo + step]
            near = np.bitwise_count(h[:, None] ^ part[None, :]) <= bits
            if near.sum() <= np.isin(part, h).sum():  # each point only meets itself
                continue
            low_h, low_y = h.copy(), part.copy()
            while True:  # smallest point of each component of the block
                new_h = np.minimum(low_h, np.where(near, low_y[None, :], FULL).min(axis=1))
                new_y = np.minimum(low_y, np.where(near, new_h[:, None], FULL).min(axis=0))
                if (new_h == low_h).all() and (new_y == low_y).all():
                    break
                low_h, low_y = new_h, new_y
            for point, low in ((h, low_h), (part, low_y)):
                out_a.append(point[point != low])
                out_b.append(low[point != low])
    if not out_a:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    pairs = np.unique(np.stack([np.concatenate(out_a), np.concatenate(out_b)], axis=1), axis=0)
    return pairs[:, 0], pairs[:, 1]


def links(points: DataFrame, bits: int = 4, shard_points: int = SHARD_POINTS,
          sample_points: int = SAMPLE_POINTS, seed: int = 5) -> DataFrame:
    """(a, b) with b < a as unsigned numbers: links that connect all points
    ``fp`` (distinct) within ``bits`` bits of each other, and no others."""
    spark = points.sparkSession
    bounded_batches(spark)
    n = points.count()
    levels = max(4, int(np.ceil(np.log2(max(n, 1) / shard_points)))) if n > 256 else 0
    sample_points = min(max(sample_points, 4 << levels), MOST_SAMPLED)
    sample = np.array([r[0] for r in points.orderBy(F.xxhash64("fp"), "fp").limit(sample_points).collect()],
                      np.int64).view(np.uint64)
    levels = min(levels, int(np.log2(sample_points)) - 2)
    rng = np.random.default_rng(seed)
    radius = bits // len(SEGMENTS)
    trees = [grow(sample, _mask(s), levels, rng) for s in SEGMENTS]

    def routed(batches):
        for batch in batches:
            p = np.asarray(batch.column("fp")).view(np.uint64)
            for k, tree in enumerate(trees):
                for path, idx, home in route(tree, p, _mask(SEGMENTS[k]), radius):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([f"{k}:{path}"] * len(idx)), pa.array(p[idx].view(np.int64)), pa.array(home)],
                        names=["shard", "fp", "home"])

    def search(key, table):
        shard = key[0].as_py()
        p = table.column("fp").combine_chunks().to_numpy(zero_copy_only=False).view(np.uint64)
        home = table.column("home").combine_chunks().to_numpy(zero_copy_only=False)
        a, b = shard_links(np.sort(p[home]), np.sort(p), _mask(SEGMENTS[int(shard[0])]), radius, bits,
                           np.random.default_rng(seed))
        return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})

    shards = points.select("fp").mapInArrow(routed, "shard string, fp long, home boolean")
    return shards.groupBy("shard").applyInArrow(search, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the component of every node of the links (a, b), by rounds
    of smallest neighbour and pointer jumping. Each round is checkpointed."""
    edges = cut_lineage(edges)
    both = edges.unionAll(edges.select("b", "a")).toDF("node", "other")
    labels = cut_lineage(both.groupBy("node").agg(F.min("other").alias("m"))
                         .select("node", F.least("node", "m").alias("root")))
    while True:
        near = (both.join(labels.toDF("other", "r"), "other").groupBy("node").agg(F.min("r").alias("m")))
        lower = near.join(labels, "node").select("node", F.least("root", "m").alias("root"),
                                                 (F.col("m") < F.col("root")).alias("moved"))
        jump = labels.toDF("root", "next")
        new = cut_lineage(lower.join(jump, "root", "left").select(
            "node", F.least("root", "next").alias("root"),
            (F.col("moved") | (F.col("next") < F.col("root"))).alias("moved")))
        labels = new.select("node", "root")
        if new.where("moved").limit(1).count() == 0:
            return labels


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    words: int = 4, bits: int = 4) -> DataFrame:
    """(id, fp, component_id) for every row. Only these three columns travel;
    texts are read once."""
    check_columns(df, id_col, text_col)
    own = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    found, of_point = _grouped(own, words, bits)
    # a fingerprint with more than a HOT-th of all rows is one of fewer than HOT,
    # so their broadcast is bounded and their rows stay where they are
    often = F.col("copies") * HOT > found.count()
    hot = F.broadcast(of_point.where(often))
    back = found.join(hot, "fp").unionByName(
        found.join(hot.select("fp"), "fp", "left_anti").join(of_point.where(~often), "fp"))
    return back.select(F.col("doc_id").alias(id_col), "fp", "component_id")


def _grouped(own: DataFrame, words: int, bits: int) -> tuple[DataFrame, DataFrame]:
    """The rows with fp for their text, and for each fp its number of rows, its
    group (root) and the group's smallest doc_id."""
    docs = cut_lineage(fingerprints(own, "text", words))
    points = cut_lineage(docs.groupBy("fp").agg(F.min("doc_id").alias("low"), F.count(F.lit(1)).alias("copies")))
    labels = components(links(points, bits))
    linked = cut_lineage(labels.toDF("fp", "root").join(points.drop("copies"), "fp"))
    # a table of its own, so that the next join can split a large component
    low = cut_lineage(linked.groupBy("root").agg(F.min("low").alias("component_id")))
    of_linked = linked.join(low, "root").select("fp", "root", "component_id")
    return docs, points.join(of_linked, "fp", "left").select(
        "fp", "copies", F.coalesce("root", "fp").alias("root"),
        F.coalesce("component_id", "low").alias("component_id"))


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4,
             bits: int = 4) -> DataFrame:
    """One row of each group of near-duplicates: the one with the smallest id,
    among its rows that with the smallest fingerprint, then hash of the text,
    then hash of all columns (maps aside). Rows without an id stay only if nothing in their group has one."""
    check_columns(df, id_col, text_col)
    own = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"),
                    F.xxhash64(text_col).alias("__hash"))
    found, of_point = _grouped(own, words, bits)
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "fp", "__hash"))
    # each fingerprint's best row first, so that large groups are small here
    of_fp = found.groupBy("fp").agg(best.alias("best"))
    chosen = cut_lineage(of_fp.join(of_point.select("fp", "root"), "fp").groupBy("root").agg(F.min("best").alias("best"))
                         .select(F.col("best.doc_id").alias("__id"), F.col("best.__hash").alias("__hash")))
    same = lambda a: a.eqNullSafe(F.col("__id")) & (F.col("__own") == F.col("__hash"))
    rows = (found.select("doc_id", F.col("__hash").alias("__own"))
            .join(chosen, same(F.col("doc_id")), "left_semi"))
    many = cut_lineage(rows.groupBy("doc_id", "__own").count().where("count > 1")
                       .select(F.col("doc_id").alias("__id"), F.col("__own").alias("__hash")))
    hashed = df.withColumn("__own", F.xxhash64(text_col))
    out = hashed.join(chosen, same(F.col(id_col).cast("long")), "left_semi")
    if many.limit(1).count():  # rows repeated under one id and text
        told_apart = F.xxhash64(*[c for c, kind in df.dtypes if "map<" not in kind])
        first = W.partitionBy(id_col, "__own").orderBy("__row")
        repeated = (out.join(many, same(F.col(id_col).cast("long")), "left_semi").withColumn("__row", told_apart)
                    .withColumn("__nth", F.row_number().over(first)).where("__nth = 1").drop("__row", "__nth"))
        out = out.join(many, same(F.col(id_col).cast("long")), "left_anti").unionByName(repeated)
    return out.select(*df.columns)
