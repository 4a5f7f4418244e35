"""Sharding by balanced label propagation (operator 8, native).

Linked documents (rows of equal group, by default equal texts) want to share a
shard. A label is a shard. Rounds of joins move documents towards the shard
where most of their group's rows are, as long as that shard has room: a
shard's quota is its final number of rows less the linked rows it holds, for
rows without a partner give way in the end at no cut. A group larger than a
shard fills one and its rest propagates to the next with room. After the last
round, rows without a partner (then, if they do not suffice, linked rows) move
from shards above their final number to those below, so that counts of rows
are at most one apart.

Only DataFrame functions are used. Order statistics (who moves within a quota,
slot numbers) come from counts by blocks and a window within each block, so
neither a shard nor a group is one task. The driver sees one row a shard.

Defined cases: a null text has size 1 and checksum 0 and is in the group of
null texts; rows without an id are ordered first; repeated rows are rows of
their own; ties between shards go to the smaller number; other columns are not
read, so their names cannot clash; an empty table has no shards' rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import check_columns, cut_lineage

#: Rows of a block of a count, and blocks of a shard at most.
BLOCK_ROWS, MAX_BLOCKS = 200, 20_000


def _numbered(df: DataFrame, key: str, order: list[str], out: str, n_blocks: int) -> DataFrame:
    """Adds the row's number (from 0) among the rows of its key. Rows are
    ordered by block (a hash of the group, then of the id within it, so that a
    large group spreads over blocks that follow each other) and by ``order``."""
    df = df.withColumn("__block", _block(n_blocks))
    counts = df.groupBy(key, "__block").agg(F.count(F.lit(1)).alias("__n"))
    before = counts.select(
        F.col(key).alias("__k"), F.col("__block").alias("__b"),
        (F.sum("__n").over(W.partitionBy(key).orderBy("__block")) - F.col("__n")).alias("__base"))
    out_df = df.join(before, (F.col(key) == F.col("__k")) & (F.col("__block") == F.col("__b")))
    inner = W.partitionBy(key, "__block").orderBy(*order)
    return (out_df.withColumn(out, F.col("__base") + F.row_number().over(inner) - 1)
            .drop("__block", "__k", "__b", "__base"))


def _block(n_blocks: int) -> Column:
    """A group's rows have one block, or if it is large as many in a row as it
    has times ``BLOCK_ROWS`` rows."""
    own = F.pmod(F.xxhash64("gid"), F.lit(n_blocks))
    spread = F.ceil(F.col("group_rows") / F.lit(BLOCK_ROWS)).cast("long")
    return own * F.lit(1 << 20) + F.pmod(F.xxhash64("doc_id", "rid"), spread)


def _rows_by(df: DataFrame, key: str, n_shards: int) -> list[int]:
    got = {r[0]: r[1] for r in df.groupBy(key).count().collect()}
    return [got.get(s, 0) for s in range(n_shards)]


def _quota(column: Column, values: list[int]) -> Column:
    out = F.lit(0).cast("long")
    for s, v in enumerate(values):
        out = F.when(column == s, F.lit(v).cast("long")).otherwise(out)
    return out


def propagate(docs: DataFrame, n_shards: int, room: list[int], n_blocks: int, rounds: int = 8) -> DataFrame:
    """Shard of every linked row (doc_id, rid, gid, group_rows, shard), from the
    given one on, by rounds until no row moves or ``rounds`` are over."""
    labels = cut_lineage(docs)
    for _ in range(rounds):
        held = _rows_by(labels, "shard", n_shards)
        free = [r - h for r, h in zip(room, held)]
        # each group's rows by shard, and the shard where most are among those that may grow
        votes = cut_lineage(labels.groupBy("gid", "shard").agg(F.count(F.lit(1)).alias("n")))
        can_grow = _quota(F.col("shard"), free) > 0
        # (ties go round the shards by the group's hash, so no shard draws them all)
        tie = F.pmod(F.col("shard") - F.xxhash64("gid"), F.lit(n_shards))
        best = votes.where(can_grow).groupBy("gid").agg(
            F.max(F.struct(F.col("n"), (-tie).alias("t"), F.col("shard").alias("s"))).alias("top")) \
            .select("gid", F.col("top.s").alias("to"), F.col("top.n").alias("to_n"), (-F.col("top.t")).alias("to_tie"))
        # a row moves up only: to a shard that holds more of its group, or from one above its quota
        over = _quota(F.col("shard"), [max(0, -f) for f in free]) > 0
        spare = [s for s in range(n_shards) if free[s] > 0]
        if not spare:
            break
        roomiest = F.lit(max(spare, key=lambda s: free[s]))
        wish = (votes.join(best, "gid", "left")
                .withColumn("to", F.when(over, F.coalesce(F.when(F.col("to") != F.col("shard"), F.col("to")), roomiest))
                            .when((F.col("to_n") > F.col("n")) |
                                  ((F.col("to_n") == F.col("n")) & (F.col("to_tie") < tie)), F.col("to")))
                .where("to IS NOT NULL AND to <> shard").select("gid", "shard", "to"))
        wish = cut_lineage(wish)
        moving = labels.join(wish, ["gid", "shard"])
        # from a shard above its quota only the excess moves; into a shard only as many as it has room for
        out_rank = _numbered(moving, "shard", ["gid", "doc_id", "rid"], "__out", n_blocks)
        excess = _quota(F.col("shard"), [max(0, -f) for f in free])
        leaving = out_rank.where((excess == 0) | (F.col("__out") < excess)).drop("__out")
        ranked = _numbered(leaving, "to", ["gid", "doc_id", "rid"], "__in", n_blocks)
        moved = ranked.where(F.col("__in") < _quota(F.col("to"), free)).select("doc_id", "rid", "to")
        new = cut_lineage(labels.join(moved.withColumnsRenamed({"doc_id": "__d", "rid": "__r"}),
                                      F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("rid") == F.col("__r")), "left")
                          .withColumn("moved", F.col("to").isNotNull())
                          .withColumn("shard", F.coalesce("to", "shard")).drop("to", "__d", "__r"))
        labels = new.drop("moved")
        if new.where("moved").limit(1).count() == 0:
            break
    return labels


def shard_documents(df: DataFrame, n_shards: int = 8, id_col: str = "doc_id", text_col: str = "text",
                    group: Column | None = None, rounds: int = 8) -> DataFrame:
    """doc_id, size (UTF-8 bytes and 1), text_crc32, law ('rows'), shard, slot
    (from 0, gapless within the shard), grown_shard (null under this law) and
    group_rows. ``group``: what links rows, by default the text."""
    check_columns(df, id_col, text_col)
    text = F.coalesce(F.col(text_col), F.lit(""))
    linked_by = group if group is not None else F.coalesce(F.sha2(F.col(text_col), 256), F.lit("none"))
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"),
                     (F.octet_length(text) + 1).cast("long").alias("size"),
                     F.crc32(text).alias("text_crc32"), linked_by.cast("string").alias("gid"),
                     F.monotonically_increasing_id().alias("rid"))
    rows = cut_lineage(rows)
    # a table of its own, so that the join can split a hot group's partition
    sizes = cut_lineage(rows.groupBy("gid").agg(F.count(F.lit(1)).alias("group_rows")).where("group_rows > 1"))
    base = cut_lineage(rows.join(sizes, "gid", "left")
                       .withColumn("group_rows", F.coalesce("group_rows", F.lit(1).cast("long"))))
    n = base.count()
    final = [n // n_shards + (s < n % n_shards) for s in range(n_shards)]
    n_blocks = min(max(16, -(-n // (n_shards * BLOCK_ROWS))), MAX_BLOCKS)
    start = base.withColumn("shard", F.pmod(F.xxhash64("doc_id", "rid"), F.lit(n_shards)).cast("int"))
    narrow = start.where("group_rows > 1").select("doc_id", "rid", "gid", "group_rows", "shard")
    linked = propagate(narrow, n_shards, final, n_blocks, rounds)
    placed = linked.select("doc_id", "rid", "gid", "group_rows", "shard").unionByName(
        start.where("group_rows = 1").select("doc_id", "rid", "gid", "group_rows", "shard"))
    even = _even_out(cut_lineage(placed), n_shards, final, n_blocks)
    slotted = _numbered(even, "shard", ["gid", "doc_id", "rid"], "slot", n_blocks)
    facts = base.select(F.col("rid").alias("__r"), "size", "text_crc32")
    return slotted.join(facts, F.col("rid") == F.col("__r")).select(
        F.col("doc_id").alias(id_col), "size", "text_crc32", F.lit("rows").alias("law"), "shard",
        F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "group_rows")


def _even_out(placed: DataFrame, n_shards: int, final: list[int], n_blocks: int) -> DataFrame:
    """Rows above a shard's final number move to shards below theirs: rows
    without a partner first. The k-th of all rows that leave takes the k-th
    free place, places being numbered shard after shard."""
    for lone in (True, False):
        held = _rows_by(placed, "shard", n_shards)
        excess = [max(0, h - f) for h, f in zip(held, final)]
        free = [max(0, f - h) for h, f in zip(held, final)]
        if not sum(excess):
            return placed
        kind = F.col("group_rows") == 1 if lone else F.lit(True)
        may = placed.where(kind & (_quota(F.col("shard"), excess) > 0))
        ranked = _numbered(may, "shard", ["gid", "doc_id", "rid"], "__rank", n_blocks)
        leaving = ranked.where(F.col("__rank") < _quota(F.col("shard"), excess))
        left = _rows_by(leaving, "shard", n_shards) if lone else excess
        offset = [sum(left[:s]) for s in range(n_shards)]
        place = F.col("__rank") + _quota(F.col("shard"), offset)
        to, upto = F.lit(None).cast("int"), sum(free)
        for s in reversed(range(n_shards)):
            to = F.when(place < upto, F.lit(s)).otherwise(to) if free[s] else to
            upto -= free[s]
        moves = leaving.select(F.col("rid").alias("__r"), to.alias("to")).where("to IS NOT NULL")
        placed = cut_lineage(placed.join(moves, F.col("rid") == F.col("__r"), "left")
                             .withColumn("shard", F.coalesce("to", "shard")).drop("to", "__r"))
    return placed


def cut_links(placed: DataFrame, group: str = "gid", shard: str = "shard") -> DataFrame:
    """How well groups stay together: one row with the number of groups, of
    groups in more than one shard, and of links cut, where a group's rows are
    linked to the group's largest part (rows outside of it)."""
    by_shard = placed.groupBy(group, shard).agg(F.count(F.lit(1)).alias("n"))
    by_group = by_shard.groupBy(group).agg(F.sum("n").alias("rows"), F.max("n").alias("most"),
                                           F.count(F.lit(1)).alias("shards"))
    return by_group.agg(F.count(F.lit(1)).alias("groups"), F.count_if(F.col("shards") > 1).alias("split_groups"),
                        F.coalesce(F.sum(F.col("rows") - F.col("most")), F.lit(0)).alias("cut_links"))
