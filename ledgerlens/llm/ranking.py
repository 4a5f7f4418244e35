"""Ranked lexical search by the Best Position Algorithm (operator 12).

Each item (query) is a set of terms. A document's score is the sum over the
item's terms of an impact: the term's weight times a saturating function of its
occurrences, damped by the document's length, all in whole numbers (``Impacts``).

Documents are first indexed: one row each with its length and its occurrences
of the items' terms, written once. The index gives the corpus figures (number
of documents, number of terms, documents of each term), which give the impacts.
Then each task takes its rows in blocks of bounded size and turns a block into
impact lists: for each term the documents that hold it, highest impact first.
An item reads its lists in step, position by position (sorted access). A
document that shows up for the first time is looked up in the item's other
lists at once (direct access), which gives its score and its positions there.
A list's best position is the last of the positions from the first on that have
all been seen, by either access. A document not yet seen lies behind the best
position of each list, so the impacts at the best positions bound its score:
reading stops when their sum is strictly below the k-th best score (equal
scores go by id, so an equal bound does not stop). The k best of a block carry
over to the task's next blocks, which then stop sooner or are not read at all.
The tasks' k best are merged by a top-k window.

Only the items' terms reach the tasks. Items go in batches of at most
``ITEM_BYTES`` of text (a longer single item is a batch of its own), each with
its own index, so neither driver nor tasks hold all items.

Defined cases: a null or empty text has no term, and such a document is none of
the N documents; an item without known terms has no row; items that repeat with
id and text are one item, equal ids with different texts are ranked each;
repeated documents are documents each; equal scores go by id, documents without
an id last; an empty table on either side has no result; whole texts are read;
other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import bounded_batches, check_columns, cut_lineage, slices, text_bytes

ITEM_BYTES = 8 << 20
BLOCK_POSTINGS = 1 << 20
NO_ID = (1 << 63) - 1

#: Terms are runs of ASCII letters and digits and of characters beyond ASCII;
#: of letters only A-Z are lowered. All other bytes part terms.
TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def terms(text: bytes) -> list[bytes]:
    return text.translate(TERM_BYTES).split()


class Impacts:
    """Whole-number impacts of terms in documents."""

    def __init__(self, n_docs: int, n_terms: int, df: list[int]):
        self.n, self.l = n_docs, max(n_terms, 1)
        self.w = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * x + 1))) if x else 0 for x in df],
                          np.int64)

    def __call__(self, term: np.ndarray, tf: np.ndarray, length: np.ndarray) -> np.ndarray:
        wide = 90 * int(length.max(initial=0)) * self.n >= 1 << 63
        length = length.astype(object) if wide else length
        m = (10 + 90 * length * self.n // self.l).astype(np.int64)
        return self.w[term] * (1000000000 * tf // (1000 * tf + 8 * m))


class Block:
    """Impact lists of one block of documents."""

    def __init__(self, ids: np.ndarray, ptr: np.ndarray, term: np.ndarray, impact: np.ndarray, n_terms: int):
        self.ids, self.ptr, self.term, self.impact, self.n_terms = ids, ptr, term, impact, n_terms
        self.owner = np.repeat(np.arange(len(ids)), np.diff(ptr))
        self.listed = np.lexsort((-impact, term))           # postings by list, highest impact first
        self.start = np.searchsorted(term[self.listed], np.arange(n_terms + 1))
        self.place = np.empty(len(term), np.int64)          # of each posting in its list
        self.place[self.listed] = np.arange(len(term)) - self.start[term[self.listed]]

    def postings(self, docs: np.ndarray) -> np.ndarray:
        """All postings of these documents (direct access)."""
        sizes = self.ptr[docs + 1] - self.ptr[docs]
        ends = np.cumsum(sizes)
        return np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.ptr[docs] - (ends - sizes), sizes)

    def search(self, asked: np.ndarray, k: int, best: tuple[np.ndarray, np.ndarray],
               step: int = 16) -> tuple[np.ndarray, np.ndarray, int]:
        """The k best (ids, scores) of ``best`` and this block for the distinct
        terms ``asked``, and how many of its documents were looked at."""
        lists = asked[self.start[asked + 1] > self.start[asked]]
        begin, size = self.start[lists], self.start[lists + 1] - self.start[lists]
        looked = 0
        if not len(lists):
            return *best, looked
        slot = np.full(self.n_terms, -1)
        slot[lists] = np.arange(len(lists))
        offset = np.cumsum(size) - size
        seen_at = np.zeros(int(size.sum()), bool)
        at = np.arange(len(seen_at))
        seen = np.zeros(len(self.ids), bool)
        top = self.impact[self.listed[begin]]               # bound before anything is seen
        depth = 0
        while True:
            if len(best[0]) >= k and top.sum() < best[1][k - 1]:
                break
            if depth >= size.max():
                break
            upto = depth + step
            read = np.concatenate([self.listed[b + min(depth, n):b + min(upto, n)]
                                   for b, n in zip(begin.tolist(), size.tolist())])
            depth, step = upto, 2 * step
            docs = np.unique(self.owner[read])
            docs = docs[~seen[docs]]
            if len(docs):
                seen[docs] = True
                looked += len(docs)
                p = self.postings(docs)
                p = p[slot[self.term[p]] >= 0]
                seen_at[offset[slot[self.term[p]]] + self.place[p]] = True
                total = np.zeros(len(self.ids), np.int64)
                np.add.at(total, self.owner[p], self.impact[p])
                best = merged(best, (self.ids[docs], total[docs]), k)
            # best positions: the first place of each list not seen
            unseen = np.minimum.reduceat(np.where(seen_at, len(at), at), offset)
            position = np.minimum(unseen - offset, size)
            top = np.where(position >= size, 0, self.impact[self.listed[begin + np.maximum(position - 1, 0)]])
        return *best, looked


def merged(a, b, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of two lists of (ids, scores): highest first, then by id;
    only scores above 0."""
    ids, scores = np.concatenate([a[0], b[0]]), np.concatenate([a[1], b[1]])
    on = np.flatnonzero(scores > (np.partition(scores, len(scores) - k)[len(scores) - k] - 1 if len(scores) > k else 0))
    on = on[scores[on] > 0]
    order = on[np.lexsort((ids[on], -scores[on]))[:k]]
    return ids[order], scores[order]


def index(docs: DataFrame, id_col: str, text_col: str, vocabulary: dict[bytes, int]) -> DataFrame:
    """One row for each document with a term: id, n (terms with repeats), and
    the numbers of the vocabulary's terms it holds with their occurrences, as
    packed 32-bit integers."""

    def run(batches):
        number = vocabulary.get
        for whole in batches:
            for batch in slices(whole, "text"):
                ids, n, term, tf = [], [], [], []
                for key, text in zip(batch.column("id").to_pylist(), text_bytes(batch.column("text"))):
                    words = terms(text)
                    if not words:
                        continue
                    held = sorted((number(t), c) for t, c in Counter(words).items() if t in vocabulary)
                    ids.append(key)
                    n.append(len(words))
                    term.append(np.array([x for x, _ in held], np.int32).tobytes())
                    tf.append(np.array([min(c, (1 << 31) - 1) for _, c in held], np.int32).tobytes())
                yield pa.RecordBatch.from_pydict({"id": pa.array(ids, pa.int64()), "n": pa.array(n, pa.int64()),
                                                  "term": pa.array(term, pa.binary()), "tf": pa.array(tf, pa.binary())})

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(
        run, "id long, n long, term binary, tf binary")


def figures(indexed: DataFrame, n_terms: int) -> Impacts:
    """Impacts from the index's counts; the driver receives one row a term."""

    def run(batches):
        df = np.zeros(n_terms, np.int64)
        for batch in batches:
            flat = np.frombuffer(b"".join(batch.column("term").to_pylist()), np.int32)
            df += np.bincount(flat, minlength=n_terms)
        on = np.flatnonzero(df)
        yield pa.RecordBatch.from_pydict({"term": pa.array(on.astype(np.int32)), "df": pa.array(df[on])})

    n, length = indexed.agg(F.count(F.lit(1)), F.sum("n")).first()
    found = [0] * n_terms
    for t, c in indexed.select("term").mapInArrow(run, "term int, df long").groupBy("term").agg(F.sum("df")).collect():
        found[t] = c
    return Impacts(n, length or 0, found)


def rank(indexed: DataFrame, impacts: Impacts, asked: list[np.ndarray], k: int) -> DataFrame:
    """The k best of every task for every item: item (its number), id, score."""
    n_terms = len(impacts.w)

    def blocks(batches):
        held, size = [], 0
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                held.append(batch.slice(lo, 256))
                size += sum(map(len, held[-1].column("term").to_pylist())) // 4
                if size >= BLOCK_POSTINGS:
                    yield held
                    held, size = [], 0
        if held:
            yield held

    def block(held):
        ids = np.array([NO_ID if x is None else x for b in held for x in b.column("id").to_pylist()], np.int64)
        n = np.concatenate([b.column("n").to_numpy() for b in held])
        term, tf = ([x for b in held for x in b.column(c).to_pylist()] for c in ("term", "tf"))
        sizes = np.array([len(x) // 4 for x in term])
        flat = np.frombuffer(b"".join(term), np.int32).astype(np.int64)
        impact = impacts(flat, np.frombuffer(b"".join(tf), np.int32).astype(np.int64), np.repeat(n, sizes))
        return Block(ids, np.concatenate([[0], np.cumsum(sizes)]), flat, impact, n_terms)

    def run(batches):
        nothing = np.zeros(0, np.int64)
        best = [(nothing, nothing)] * len(asked)
        for held in blocks(batches):
            b = block(held)
            for i, own in enumerate(asked):
                best[i] = b.search(own, k, best[i])[:2]
        items = np.repeat(np.arange(len(asked)), [len(x) for x, _ in best])
        ids = np.concatenate([x for x, _ in best]) if best else nothing
        scores = np.concatenate([y for _, y in best]) if best else nothing
        yield pa.RecordBatch.from_pydict({"item": pa.array(items.astype(np.int32)),
                                          "id": pa.array(ids, mask=ids == NO_ID), "score": pa.array(scores)})

    return indexed.mapInArrow(run, "item int, id long, score long")


def item_batches(items: DataFrame, text_col: str, limit: int = ITEM_BYTES) -> tuple[DataFrame, int]:
    """Items with a column ``__batch`` and the number of batches. A batch has
    at most ``limit`` bytes of text, or is one that more cuts do not part."""
    size = F.coalesce(F.octet_length(text_col), F.lit(0))
    total = items.agg(F.sum(size)).first()[0] or 0
    n = max(1, -(-total // limit))
    while True:
        made = items.withColumn("__batch", F.pmod(F.xxhash64(text_col), F.lit(n)))
        if n == 1:
            return made, n
        over = made.groupBy("__batch").agg(F.sum(size).alias("s"), F.count_distinct(text_col).alias("c")).where(
            (F.col("s") > limit) & (F.col("c") > 1))
        if over.isEmpty():
            return made, n
        n *= 2


def search(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text",
           item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The k documents with the highest score above 0 for each item:
    ``item_col``, rank (from 1), ``id_col``, score."""
    check_columns(docs, id_col, text_col)
    check_columns(items, item_col, item_text_col)
    bounded_batches(docs.sparkSession)
    spark = docs.sparkSession
    wanted = items.select(F.col(item_col).alias("item_id"), F.col(item_text_col).alias("text")).distinct()
    wanted, n_batches = item_batches(wanted, "text")
    found = None
    for b in range(n_batches):
        own = wanted.where(F.col("__batch") == b).select("item_id", "text").orderBy("item_id", "text").collect()
        sets = [set(terms((r.text or "").encode())) for r in own]
        vocabulary = {t: i for i, t in enumerate(sorted(set().union(*sets)))}
        indexed = cut_lineage(index(docs, id_col, text_col, vocabulary))
        asked = [np.array(sorted(vocabulary[t] for t in s), np.int64) for s in sets]
        best = rank(indexed, figures(indexed, len(vocabulary)), asked, k)
        order = W.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("id"))
        best = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        names = spark.createDataFrame([(i, r.item_id) for i, r in enumerate(own)],
                                      wanted.select(F.lit(0).alias("item"), "item_id").schema)
        best = best.join(names, "item").select(F.col("item_id").alias(item_col), "rank",
                                               F.col("id").alias(id_col), "score")
        found = best if found is None else found.unionAll(best)
    return found
