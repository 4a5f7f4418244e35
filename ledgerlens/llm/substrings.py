"""Substring dedup over token windows (operator 3).

Every window of ``width`` consecutive words of a document has a Rabin-Karp
hash: a polynomial in the words' 64-bit hashes, modulo 2**64, rolled along the
document. A word is removed if a window that covers it also starts in a
document with a smaller id. Chunks are ranges of ids in order (chunks of one
heavy id have one rank), so for a window it is enough to know whether a chunk of
smaller rank has it (one bit, counted per bucket of hashes in Spark) or an
earlier document of its own chunk. Repeated windows are merged into maximal
intervals of removed words.

Windows are compared by 64-bit hashes: among n distinct windows a false match
is expected about n**2 / 2**65 times (4e-4 at 100 million windows).

Defined cases: a null or empty text has no words; a text shorter than a
window keeps all its words; copies within one document or under one id do not
remove each other; rows without an id neither remove nor lose words, so they are
not exchanged; extra
columns pass through and output columns replace input columns of the same
name.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, check_columns, schema_with, slices, text_bytes
from .exchange import CHUNK, RANK, Layout, bucket_edges, dealt, dealt_texts, distinct, mix, pack, squeeze, stretch, unpack

BASE = np.uint64(0x9E3779B97F4A7C15)  # fixed value: an odd multiplier
WORDS = re.compile(rb"[^\x20\x09-\x0D]+")


class WordHashes(dict):
    """Word -> 64-bit hash, for the words of one chunk."""

    def __missing__(self, word: bytes) -> int:
        from xxhash import xxh64_intdigest
        value = self[word] = xxh64_intdigest(word, 7)
        return value


def windows(docs: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of the window from every word on, is there such a window, number
    of words of each document) over all documents in a row."""
    hashes = WordHashes()
    rows = [np.fromiter(map(hashes.__getitem__, d.split()), np.uint64) for d in docs]
    counts = np.array([len(r) for r in rows], np.int64)
    flat = np.concatenate(rows) if rows else np.zeros(0, np.uint64)
    n = len(flat)
    value = np.zeros(n, np.uint64)
    if n >= width:
        rolled = np.zeros(n - width + 1, np.uint64)
        for k in range(width):
            rolled = rolled * BASE + flat[k:n - width + 1 + k]
        value[:n - width + 1] = mix(rolled)
    ends = np.repeat(np.cumsum(counts), counts)
    return value, np.arange(n) + width <= ends, counts


def removed_words(ids: np.ndarray, counts: np.ndarray, value: np.ndarray, there: np.ndarray,
                  earlier: np.ndarray, width: int) -> np.ndarray:
    """Which words of a chunk's documents (in order of id) a repeated window
    covers. ``earlier``: for each distinct window, has an earlier chunk it."""
    at = np.flatnonzero(there)
    distinct, first, which = np.unique(value[at], return_index=True, return_inverse=True)
    owner = np.repeat(ids, counts)[at]
    repeated = earlier[which] | (owner[first][which] < owner)
    edge = np.zeros(len(value) + 1, np.int64)
    hit = at[repeated]
    edge[hit] += 1
    np.add.at(edge, hit + width, -1)
    return np.cumsum(edge)[:-1] > 0


def without(text: bytes, gone: np.ndarray) -> bytes:
    """The text without these words and the white space after each run of
    them; the rest keeps its layout."""
    spans = [m.span() for m in WORDS.finditer(text)]
    out, keep_from = [], 0
    for a, b in intervals(gone):
        out.append(text[keep_from:spans[a][0]])
        keep_from = spans[b][0] if b < len(spans) else len(text)
    out.append(text[keep_from:])
    kept = b"".join(out)
    return kept.rstrip(b" \t\n\r\x0b\x0c") if len(gone) and gone[-1] else kept


def intervals(gone: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of true, as [start, end)."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist()))


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   width: int = 13) -> DataFrame:
    """The rows with the repeated words taken out of the text, and n_words,
    n_removed and ``removed`` (maximal intervals of removed words, as word
    numbers [start, end)) beside them."""
    check_columns(df, id_col, text_col)
    bounded_batches(df.sparkSession)
    layout = Layout(df, id_col, text_col)
    n_buckets = layout.n_buckets
    known = F.col(id_col).isNotNull()
    docs = dealt(df.where(known), text_col, layout.place)

    def in_order(table):
        ids = table.column(id_col).combine_chunks().cast(pa.int64()).to_numpy(zero_copy_only=False)
        order = np.argsort(ids, kind="stable")
        return table.take(pa.array(order)), ids[order]

    def listed(key, table):
        value, there, _ = windows(dealt_texts(table.column(text_col)), width)
        keys = distinct(value[there])
        buckets, edges = bucket_edges(keys, n_buckets)
        n = len(buckets)
        return pa.table({"chunk": pa.array([key[0].as_py()] * n, pa.int64()),
                         "rank": pa.array([table.column(RANK)[0].as_py()] * n, pa.int64()),
                         "bucket": pa.array(buckets, pa.int32()),
                         "keys": pa.array([pack(keys[a:b]) for a, b in zip(edges, edges[1:])], pa.binary())})

    def counted(key, table):
        table = table.sort_by([("rank", "ascending"), ("chunk", "ascending")])
        lists = [unpack(b) for b in table.column("keys").to_pylist()]
        sizes = [len(x) for x in lists]
        flat = np.concatenate(lists)
        rank = np.repeat(table.column("rank").combine_chunks().to_numpy(zero_copy_only=False), sizes)
        # equal keys stay in order of rank: the first has the smallest
        _, first, which = np.unique(flat, return_index=True, return_inverse=True)
        again = rank > rank[first][which]
        cuts = np.cumsum(sizes)[:-1]
        return pa.table({CHUNK: table.column("chunk"), "bucket": table.column("bucket"),
                         "seen": pa.array([squeeze(np.packbits(x)) for x in np.split(again, cuts)], pa.binary()),
                         "n": pa.array(sizes, pa.int64())})

    out_ddl = schema_with(df, f"`{text_col}` string, n_words long, n_removed long, "
                              "removed array<struct<start:int,end:int>>")

    def cut(key, table, answers):
        table = table.drop_columns([CHUNK, RANK])
        if table.num_rows:
            table, ids = in_order(table)
        docs_ = dealt_texts(table.column(text_col))
        value, there, counts = windows(docs_, width)
        gone = np.zeros(len(value), bool)
        if there.any():
            answers = answers.sort_by("bucket")
            earlier = np.concatenate([np.unpackbits(stretch(s, np.uint8), count=n).astype(bool) for s, n in
                                      zip(answers.column("seen").to_pylist(), answers.column("n").to_pylist())])
            gone = removed_words(ids, counts, value, there, earlier, width)
        return result(table, docs_, counts, gone)

    def result(table, docs_, counts, gone):
        nulls = table.column(text_col).is_null().to_pylist()
        kept, spans, n_removed, lo = [], [], [], 0
        for text, n, null in zip(docs_, counts.tolist(), nulls):
            own = gone[lo:lo + n]
            lo += n
            hit = int(own.sum())
            n_removed.append(hit)
            spans.append([{"start": a, "end": b} for a, b in intervals(own)] if hit else [])
            kept.append(None if null else (without(text, own) if hit else text).decode())
        new = {text_col: pa.array(kept, pa.string()), "n_words": pa.array(counts),
               "n_removed": pa.array(n_removed, pa.int64()),
               "removed": pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))}
        rest = [c for c in table.column_names if c not in new]
        return pa.table({c: table.column(c) for c in rest} | new)

    def alone(batches):
        """Rows without an id keep all their words."""
        for whole in batches:
            for batch in slices(whole, text_col):
                docs_ = text_bytes(batch.column(text_col))
                counts = np.array([len(t.split()) for t in docs_], np.int64)
                yield from result(pa.Table.from_batches([batch]), docs_, counts, np.zeros(counts.sum(), bool)).to_batches()

    lists = docs.groupBy(CHUNK).applyInArrow(listed, "chunk long, rank long, bucket int, keys binary")
    seen = lists.groupBy("bucket").applyInArrow(counted, f"`{CHUNK}` long, bucket int, seen binary, n long")
    done = docs.groupBy(CHUNK).cogroup(seen.groupBy(CHUNK)).applyInArrow(cut, out_ddl)
    return done.unionAll(df.where(~known).mapInArrow(alone, out_ddl))
