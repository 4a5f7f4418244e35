"""Chunks of documents and packed key lists.

Operators that look up every window or word pair of a corpus would shuffle far
more rows than there is text. Here documents are dealt into chunks of a few
megabytes (their texts compressed for the way); a chunk lists its distinct
64-bit keys once, sorted and cut into buckets by their size, as packed binary
rows (about 6 bytes a key); each bucket answers every chunk with one value a
key, in the order of its list; and the chunk, whose rows did not move meanwhile
(one shuffle by chunk, reused by every step of the plan), lines answers and keys
up again. Hot keys cost one entry a chunk, whatever their number of rows.

A chunk writes a row only for buckets in which it has keys, so there are never
more rows than keys. Chunks and buckets grow with the square root of the input
(``sizes``), which keeps ``KEYS_A_ROW`` keys and more in a row up to about
2.5 TB of text, where they reach ``MOST_BYTES``; beyond, rows get shorter and
the exchange becomes one of plain (key, chunk) rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import parts, schema_with, slices, text_bytes, with_columns

CHUNK_BYTES = 6 << 20
BUCKET_BYTES = 12 << 20
MOST_BYTES = 32 << 20
KEYS_A_ROW = 64
#: Text bytes for one distinct key, nearly.
BYTES_A_KEY = 6
RANGES = 2048
CHUNK, RANK, HASH = "__chunk", "__rank", "__hash"

# odd multipliers of a 64-bit finaliser: fixed values, any odd numbers would do
M1, M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit keys over all bits (a bijection)."""
    x = (x ^ (x >> np.uint64(33))) * M1
    x = (x ^ (x >> np.uint64(33))) * M2
    return x ^ (x >> np.uint64(33))


def distinct(keys: np.ndarray) -> np.ndarray:
    """The distinct keys, rising. Sorting is many times faster here than the
    hash table that ``np.unique`` takes for millions of different keys."""
    keys = np.sort(keys)
    return keys[np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))] if len(keys) else keys


def numbered(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct keys, rising; a place of each; which of them each key is). Any
    place will do here, so the fast unstable sort does too."""
    order = np.argsort(keys)
    ranked = keys[order]
    new = np.append(True, ranked[1:] != ranked[:-1])[:len(keys)]
    which = np.empty(len(keys), np.int64)
    which[order] = np.cumsum(new) - 1
    return ranked[new], order[new], which


def bucket_edges(keys: np.ndarray, n_buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The buckets that hold some of the sorted keys, rising, and where each
    begins in them (one place more, the end). Bucket b holds the keys from
    b * 2**64 // n_buckets on."""
    if not len(keys):
        return np.zeros(0, np.int64), np.zeros(1, np.int64)
    bucket = keys // np.uint64((1 << 64) // n_buckets) if n_buckets > 1 else np.zeros(len(keys), np.uint64)
    bucket = np.minimum(bucket, np.uint64(n_buckets - 1)).astype(np.int64)
    begin = np.flatnonzero(np.diff(bucket, prepend=-1))
    return bucket[begin], np.append(begin, len(keys))


def spans(keys: np.ndarray, n_buckets: int, buckets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the sorted keys of these buckets (rising) begin and end."""
    own, edges = bucket_edges(keys, n_buckets)
    begin = edges[np.searchsorted(own, buckets, "left")]
    end = edges[np.searchsorted(own, buckets, "right")]
    return begin, end


def pack(keys: np.ndarray) -> bytes:
    """Sorted distinct keys as differences of as few bytes as nearly all of
    them need; the high parts of the others are listed at the end."""
    if not len(keys):
        return b""
    gaps = np.diff(keys, prepend=np.uint64(0))
    size = 8
    for narrow in (4, 5, 6, 7):
        if (gaps[1:] >> np.uint64(8 * narrow) > 0).sum() * 16 <= len(gaps):
            size = narrow
            break
    body = np.ascontiguousarray(gaps[1:].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size])
    wide = np.flatnonzero(gaps[1:] >> np.uint64(8 * size)) + 1 if size < 8 else np.zeros(0, np.int64)
    high = gaps[wide] >> np.uint64(8 * size) if size < 8 else np.zeros(0, np.uint64)
    return (bytes([size]) + len(keys).to_bytes(4, "little") + keys[:1].astype("<u8").tobytes() + body.tobytes()
            + wide.astype("<u4").tobytes() + high.astype("<u4").tobytes())


def unpack(blob: bytes) -> np.ndarray:
    if not blob:
        return np.zeros(0, np.uint64)
    size, n = blob[0], int.from_bytes(blob[1:5], "little")
    gaps = np.zeros((n, 8), np.uint8)
    gaps[0] = np.frombuffer(blob, np.uint8, count=8, offset=5)
    gaps[1:, :size] = np.frombuffer(blob, np.uint8, count=(n - 1) * size, offset=13).reshape(-1, size)
    gaps = gaps.view("<u8").ravel()
    rest = np.frombuffer(blob, "<u4", offset=13 + (n - 1) * size)
    if len(rest):
        gaps[rest[:len(rest) // 2]] += rest[len(rest) // 2:].astype(np.uint64) << np.uint64(8 * size)
    return np.cumsum(gaps, dtype=np.uint64)


def squeeze(values: np.ndarray) -> bytes:
    """Mostly small values, compressed byte plane by byte plane."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.dtype.itemsize).T
    return zstandard.compress(np.ascontiguousarray(planes).tobytes(), 3)


def stretch(blob: bytes, kind) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(blob), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def sizes(n_bytes: int) -> tuple[int, int]:
    """Text bytes of a chunk and of a bucket for so many bytes of text."""
    side = int((KEYS_A_ROW * BYTES_A_KEY * n_bytes) ** 0.5) + 1
    return (min(max(CHUNK_BYTES, side), MOST_BYTES), min(max(BUCKET_BYTES, side), MOST_BYTES))


def row_hash(df: DataFrame) -> "F.Column":
    """A hash of the whole row (columns that cannot be hashed left out)."""
    return F.xxhash64(*[F.col(f"`{f.name}`") for f in df.schema.fields
                        if not any(k in f.dataType.simpleString() for k in ("map<", "variant", "interval"))])


def dealt(df: DataFrame, text_col: str, place) -> DataFrame:
    """The rows with their chunk and rank and the text compressed. ``place``
    (batch, hashes, occurrences) -> (chunk, rank): rows that are equal in all
    columns are numbered within a task, so equal rows can be spread, and which of
    them goes where does not matter when a task runs again."""
    names = df.columns

    def run(batches):
        pack_text = zstandard.ZstdCompressor(level=3).compress
        seen: dict[int, int] = {}
        for whole in batches:
            for batch in slices(whole, text_col):
                hashes = batch.column(HASH).to_numpy(zero_copy_only=False)
                nth = np.zeros(len(hashes), np.int64)
                for i, h in enumerate(hashes.tolist()):
                    nth[i] = seen[h] = seen.get(h, -1) + 1
                batch = batch.select(names)
                chunk, rank = place(batch, hashes, nth)
                null = batch.column(text_col).is_null().to_pylist()
                packed = [None if n else pack_text(t) for t, n in zip(text_bytes(batch.column(text_col)), null)]
                yield with_columns(batch, {text_col: pa.array(packed, pa.binary()), CHUNK: pa.array(chunk, pa.int64()),
                                           RANK: pa.array(rank, pa.int64())})

    return df.withColumn(HASH, row_hash(df)).mapInArrow(
        run, schema_with(df, f"`{text_col}` binary, `{CHUNK}` long, `{RANK}` long"))


def dealt_texts(column) -> list[bytes]:
    """The texts of dealt rows, null as empty."""
    unpack_text = zstandard.ZstdDecompressor().decompress
    return [b"" if t is None else unpack_text(t) for t in column.to_pylist()]


class Layout:
    """Chunks for a corpus in order of id: about ``chunk_bytes`` of text each,
    whatever the lengths of the texts.

    Quantiles of the ids (``RANGES`` at most) cut the rows into ranges; an id that
    shows up in several quantiles is a range of its own. The bytes of each range
    are counted. Light neighbours share a chunk; a heavy range is cut evenly by
    id, a heavy single id by the hash of its rows. ``rank`` rises with the id and
    is equal for chunks of one id. Rows without an id have no place here."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str):
        self.id_col = id_col
        least = parts(docs.sparkSession)
        i = F.col(id_col).cast("long")
        some = docs.where(i.isNotNull())
        rows, size = some.agg(F.count(F.lit(1)), F.sum(F.octet_length(text_col))).first()
        size = int(size or 0)
        chunk_bytes, bucket_bytes = sizes(size)
        chunk_bytes = min(chunk_bytes, max(1, -(-size // least)))
        self.n_buckets = max(least, -(-size // bucket_bytes))
        self.edges = np.zeros(1, np.int64)
        self.base, self.steps, self.single = np.zeros(1, np.int64), np.ones(1, np.int64), np.zeros(1, bool)
        pieces = min(RANGES, 16 * -(-size // chunk_bytes), rows)
        if pieces < 2:
            return
        got = some.agg(F.percentile_approx(i, [k / pieces for k in range(pieces + 1)], 20000)).first()[0]
        bounds, repeats = np.unique(np.array(got, np.int64), return_counts=True)
        hot = bounds[repeats > 1]
        self.edges = np.unique(np.concatenate([bounds, hot, hot + 1]))
        counted = np.zeros(len(self.edges), np.int64)
        for r, n in some.select(id_col, text_col).mapInArrow(self._bytes(text_col), "range long, bytes long").groupBy(
                "range").agg(F.sum("bytes")).collect():
            counted[r] = n
        self.single = np.isin(self.edges, hot)
        self.steps = np.maximum(1, -(-counted // chunk_bytes))
        self.base = np.zeros(len(self.edges), np.int64)
        chunk, free, held = 0, 0, chunk_bytes + 1
        for r, (n, steps) in enumerate(zip(counted.tolist(), self.steps.tolist())):
            if steps > 1 or held + n > chunk_bytes:
                chunk, free, held = free, free + steps, 0
            self.base[r] = chunk
            held = held + n if steps == 1 else chunk_bytes + 1

    def _range(self, ids: np.ndarray) -> np.ndarray:
        return np.maximum(np.searchsorted(self.edges, ids, "right") - 1, 0)

    def _bytes(self, text_col: str):
        def run(batches):
            import pyarrow.compute as pc
            total = np.zeros(len(self.edges), np.int64)
            for batch in batches:
                ids = batch.column(self.id_col).cast(pa.int64()).to_numpy(zero_copy_only=False)
                n = pc.fill_null(pc.binary_length(batch.column(text_col)), 0).to_numpy(zero_copy_only=False)
                np.add.at(total, self._range(ids), n)
            on = np.flatnonzero(total)
            yield pa.RecordBatch.from_pydict({"range": pa.array(on), "bytes": pa.array(total[on])})
        return run

    def place(self, batch, hashes: np.ndarray, nth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ids = batch.column(self.id_col).cast(pa.int64()).to_numpy(zero_copy_only=False)
        r = self._range(ids)
        low, steps = self.edges[r], self.steps[r]
        high = np.append(self.edges[1:], self.edges[-1] + 1)[r]
        within = np.floor((ids - low).astype(float) * steps / np.maximum(high - low, 1)).astype(np.int64)
        within = np.clip(within, 0, steps - 1)
        spread = (hashes.view(np.uint64) % np.uint64(1 << 32)).astype(np.int64) + nth
        chunk = self.base[r] + np.where(self.single[r], spread % steps, within)
        return chunk, np.where(self.single[r], self.base[r], chunk)
