"""Mixing sources to target weights by min-cost flow (operator 10).

A document may belong to several sources. Documents are aggregated by
membership pattern (the set of sources that hold them), so the flow network
has a node for each pattern and each source, not for documents: pattern p
offers its words ``max_repeats`` times, the k-th pass at cost k (convex, so a
first use is preferred to a repetition), and source s asks for its quota.
Successive shortest paths route the words; a min-cost flow takes each pass of
a pattern whole before the next. Documents are then picked in a seeded order
within their pattern until the routed words are reached; the document at the
edge is taken in part, so a pattern's words are met exactly.

Patterns (at most ``MAX_PATTERNS``, checked) are the only rows that reach the
driver. Running sums over a pattern's documents go by blocks, so a pattern
with a third of all rows is no single task.

Defined cases: a null or empty text has size 0 and is taken 0 times; a null
source is a source of its own, after all others; repeated rows are documents
of their own; the seeded order goes by the id, the text and the other columns
(maps aside), and rows that agree in everything share alike; extra columns pass through, output columns
replace input columns of the same name; an empty table has an empty mix.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import check_columns, cut_lineage, n_words

MAX_PATTERNS = 100_000
#: Rows of a block of a running sum, and blocks of a pattern at most.
BLOCK_ROWS, MAX_BLOCKS = 500, 20_000


def targets(sizes: list[float], weights: list[float], share: float = 1.5, most: float = 2.0) -> list[float]:
    """Quotas: ``share`` of all sizes divided by weight; a quota stops at
    ``most`` times its source's size, and the excess is shared anew by weight
    among the others until none is above."""
    left, quota, free = share * sum(sizes), [0.0] * len(sizes), [i for i, s in enumerate(sizes) if s > 0]
    while free:
        total = sum(weights[i] for i in free)
        full = [i for i in free if left * weights[i] / total >= most * sizes[i]]
        if not full:
            for i in free:
                quota[i] = left * weights[i] / total
            break
        for i in full:
            quota[i] = most * sizes[i]
        left -= sum(quota[i] for i in full)
        free = [i for i in free if i not in set(full)]
    return quota


def min_cost_flow(sizes: dict, members: dict, quotas: dict, passes: int = 2) -> dict:
    """Words that each pattern sends to each source: {(pattern, source): words}.

    Arcs: start -> pattern (one for each pass, capacity the pattern's words,
    cost the pass), pattern -> member source (free), source -> end (capacity
    the quota). Shortest paths with potentials; every path fills an arc."""
    names = [("start",), *(("p", p) for p in sizes), *(("s", s) for s in quotas), ("end",)]
    number = {n: i for i, n in enumerate(names)}
    head, arcs = [[] for _ in names], []

    def arc(a, b, capacity, cost):
        head[a].append(len(arcs))
        arcs.append([b, int(capacity), cost])
        head[b].append(len(arcs))
        arcs.append([a, 0, -cost])
        return len(arcs) - 2

    for p, size in sizes.items():
        for k in range(1, passes + 1):
            arc(0, number["p", p], size, k)
    to_source = {(p, s): arc(number["p", p], number["s", s], passes * size, 0)
                 for p, size in sizes.items() for s in members[p] if s in quotas}
    for s, quota in quotas.items():
        arc(number["s", s], len(names) - 1, round(quota), 0)
    potential = [0] * len(names)
    while True:
        best, via = [None] * len(names), [None] * len(names)
        best[0], heap = 0, [(0, 0)]
        while heap:
            d, a = heapq.heappop(heap)
            if d > best[a]:
                continue
            for e in head[a]:
                b, room, cost = arcs[e]
                if room > 0 and (best[b] is None or d + cost + potential[a] - potential[b] < best[b]):
                    best[b], via[b] = d + cost + potential[a] - potential[b], e
                    heapq.heappush(heap, (best[b], b))
        if best[-1] is None:
            return {k: arcs[e ^ 1][1] for k, e in to_source.items() if arcs[e ^ 1][1]}
        for i, d in enumerate(best):
            potential[i] += d if d is not None else best[-1]
        path, b = [], len(names) - 1
        while b:
            path.append(via[b])
            b = arcs[via[b] ^ 1][0]
        sent = min(arcs[e][1] for e in path)
        for e in path:
            arcs[e][1] -= sent
            arcs[e ^ 1][1] += sent


def seeded_order(id_col: str, seed: int, *rest: Column) -> Column:
    """A digest of the seed, the id and what tells rows of one id apart."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(id_col).cast("string"), F.lit("")),
                             *[x.cast("string") for x in rest]))


def running_before(df: DataFrame, key: str, order: list[str], value: str, out: str, blocks: Column) -> DataFrame:
    """Adds the sum of ``value`` over the rows of the same key that come before
    in ``order``, by blocks that follow the order: sums of blocks first, then
    a window within each block."""
    from pyspark.sql import Window as W
    df = df.withColumn("__block", blocks)
    per_block = df.groupBy(key, "__block").agg(F.sum(value).alias("__sum"))
    before = per_block.select(
        F.col(key).alias("__key"), F.col("__block").alias("__b"),
        (F.sum("__sum").over(W.partitionBy(key).orderBy("__block")) - F.col("__sum")).alias("__base"))
    joined = df.join(before, F.col(key).eqNullSafe(F.col("__key")) & (F.col("__block") == F.col("__b")))
    inner = W.partitionBy(key, "__block").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return (joined.withColumn(out, F.col("__base") + F.coalesce(F.sum(value).over(inner), F.lit(0)))
            .drop("__block", "__key", "__b", "__base"))


def mix(df: DataFrame, weights=(5, 2, 1), share: float = 1.5, repeats: int = 2, id_col: str = "doc_id",
        source_col: str = "source", text_col: str = "text", seed: int = 11, drop_text: bool = False) -> DataFrame:
    """Adds size (words), source_size and target (of the row's source; of an
    array of sources: of their sum) and taken (words that the mix takes,
    repeats counted). ``source_col`` is a string or an array of strings; the
    sources in order of code points, null last, have the weights in turn. With
    ``drop_text`` the result has no text, and what the steps need of it is written
    once, so texts are read once."""
    check_columns(df, id_col, source_col, text_col)
    spark = df.sparkSession
    multi = dict(df.dtypes)[source_col].startswith("array")
    pattern = F.array_sort(F.array_distinct(F.col(source_col))) if multi else F.array(F.col(source_col))
    # maps have no hash
    told_apart = [c for c, kind in df.dtypes if "map<" not in kind and c != "size"]
    sized = (df.withColumn("__hash", F.xxhash64(*told_apart)).withColumn("size", n_words(text_col))
             .withColumn("__pattern", F.to_json(F.struct(pattern.alias("s")), {"ignoreNullFields": "false"})))
    if drop_text:
        sized = cut_lineage(sized.drop(text_col))
    rows = sized.groupBy("__pattern").agg(F.sum("size").alias("w"), F.count(F.lit(1)).alias("n")).limit(MAX_PATTERNS + 1).collect()
    if len(rows) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} membership patterns")
    import json
    members = {r[0]: json.loads(r[0])["s"] or [] for r in rows}
    words = {r[0]: int(r[1]) for r in rows}
    sources = sorted({s for m in members.values() for s in m}, key=lambda s: (s is None, s or ""))
    size_of = {s: sum(words[p] for p, m in members.items() if s in m) for s in sources}
    # share of all sizes: a document in several sources counts once
    scale = sum(words.values()) / max(sum(size_of.values()), 1)
    quota = dict(zip(sources, targets([size_of[s] for s in sources],
                                      [weights[i % len(weights)] for i in range(len(sources))],
                                      share * scale, float(repeats))))
    flow = min_cost_flow(words, members, quota, repeats)
    routed: dict = {}
    for (p, _), w in flow.items():
        routed[p] = routed.get(p, 0) + w
    plan = spark.createDataFrame(
        [(r[0], sum(size_of[s] for s in members[r[0]]), float(sum(quota[s] for s in members[r[0]])),
          min(routed.get(r[0], 0) // max(words[r[0]], 1), repeats), routed.get(r[0], 0) % max(words[r[0]], 1),
          min(max(1, -(-r[2] // BLOCK_ROWS)), MAX_BLOCKS)) for r in rows],
        T.StructType.fromDDL("__pattern string, source_size long, target double, __whole long, __rest long, __blocks long"))
    # at most MAX_PATTERNS rows, checked above
    ordered = (sized.join(F.broadcast(plan), "__pattern")
               .withColumn("__order", seeded_order(id_col, seed, F.col("size"), F.col("__hash"))))
    # the first 8 hex digits of the order cut it into even blocks
    block = F.floor(F.conv(F.substring("__order", 1, 8), 16, 10).cast("long") * F.col("__blocks") / F.lit(1 << 32))
    out = running_before(ordered, "__pattern", ["__order", id_col], "size", "__before", block)
    part = F.least(F.greatest(F.col("__rest") - F.col("__before"), F.lit(0)), F.col("size"))
    out = out.withColumn("taken", (F.col("__whole") * F.col("size") + part).cast("long"))
    return out.drop("__pattern", "__whole", "__rest", "__blocks", "__order", "__before", "__hash")


def repeat_rows(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """The mix as rows: every document as often as it was taken, to the nearest
    whole copy (texts stay whole)."""
    copies = F.floor(F.col("taken") / F.greatest(F.col("size"), F.lit(1)) + 0.5).cast("int")
    return (mixed.withColumn("__copies", copies).where("__copies > 0")
            .select(*columns, F.explode(F.sequence(F.lit(1), F.col("__copies"))).alias("__copy"))
            .select(*columns))
