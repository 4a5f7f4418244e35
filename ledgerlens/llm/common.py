"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage, ensure_checkpoint_dir  # noqa: F401
from ..sources.ledger import read_table  # noqa: F401

#: White space that separates words: space and U+0009 to U+000D. The same set
#: that ``bytes.split()`` splits on.
WORD = r"[^\x20\x09-\x0D]+"
WHITE = b" \t\n\r\x0b\x0c"

#: Text bytes that one step of a Python worker holds at a time.
SLICE_BYTES = 2 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Hold Arrow batches to 8 MB (Spark's own bound is 64 MB), so that a batch
    of long texts does not fill a Python worker. A bound that the user has set
    is kept."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, "67108864b") == "67108864b":
        spark.conf.set(key, "8m")


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows with about ``limit`` text bytes (one row at least)."""
    import pyarrow.compute as pc
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    lo = 0
    while lo < batch.num_rows:
        before = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield batch.slice(lo, hi - lo)
        lo = hi


def texts(column) -> list[str]:
    """The strings of an Arrow column, null as empty."""
    return [t or "" for t in column.to_pylist()]


def text_bytes(column) -> list[bytes]:
    """The strings of an Arrow column as UTF-8 bytes, null as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_null(column.type):
        return [b""] * len(column)
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [t or b"" for t in column.cast(kind).to_pylist()]


def with_columns(batch: pa.RecordBatch, new: dict[str, pa.Array]) -> pa.RecordBatch:
    """The batch with the new columns; they replace columns of the same name."""
    names = [n for n in batch.schema.names if n not in new]
    return pa.RecordBatch.from_arrays([batch.column(n) for n in names] + list(new.values()),
                                      names=names + list(new))


def schema_with(df: DataFrame, new: str, drop: tuple[str, ...] = ()) -> str:
    """DDL of the frame's columns (without ``drop`` and without those that
    ``new`` replaces) followed by the columns of the DDL text ``new``."""
    from pyspark.sql.types import StructType
    added = StructType.fromDDL(new)
    gone = {*drop, *added.names}
    kept = [f for f in df.schema.fields if f.name not in gone]
    return StructType(kept + added.fields)


def check_columns(df: DataFrame, *names: str) -> None:
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {missing}")


def parts(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def n_words(column) -> "F.Column":
    """Number of words of a text column (null: 0) without Python: the words
    are the runs between white space."""
    return F.coalesce(F.regexp_count(column, F.lit(WORD)), F.lit(0)).cast("long")
