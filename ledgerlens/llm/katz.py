"""Katz back-off language model of any order (operator 9).

With c the counts of training, h a history of n - 1 words and h' the same
without its first word,

    P(w | h) = d_n(c(h w)) * c(h w) / Z(h)    where training has h w,
    P(w | h) = alpha(h) * P(w | h')           else, down to one word:
    P(w) = (c(w) + 0.5) / (N + 0.5 * (V + 1)),

spread over the V known words and one unknown word. d_n is the Good-Turing
discount of counts up to 5 among the runs of n words. alpha(h) = (1 - sum of
seen P(. | h)) / (1 - sum of the same words' P(. | h')) normalises exactly:
what follows h also follows h', so both sums run over integers (how many runs
have count 1 to 5, or more, and their totals), and no rounding depends on the
order of rows. Z(h) is c(h), or c(h) + 1 where no count of h is discounted, so
that every history keeps something for unseen words. A history that training
never saw backs off whole (alpha 1). Texts are preceded by order - 1 start
words and followed by one end word.

Counts cover all training rows. They live in tables partitioned by the hash of
a run of words and travel as packed lists (see ``exchange``): a chunk of
documents lists its runs of 1 to ``order`` words with its own training counts;
a bucket totals them and answers; chunks give, for runs they list first, what
alpha needs by history; buckets total that, for all orders at once; chunks
score each distinct run once, recursing to the shorter one where it is unseen,
and sum over their tokens.

Words are compared by 64-bit hashes, longer runs by a 64-bit hash of those.

Defined cases: a null or empty text is one end token; rows without an id are
rows like others (their training flag decides); a null training flag is false;
repeated rows count each; with no training rows every probability is that of
the unknown word; extra columns pass through ``score`` and output columns
replace input columns of the same name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, check_columns, parts, schema_with
from .exchange import CHUNK, RANK, bucket_edges, dealt, dealt_texts, mix, numbered, pack, sizes, spans, squeeze, stretch, unpack
from .substrings import BASE

START, END = np.uint64(1), np.uint64(2)
K = 5  # counts up to K are discounted
STATS = 9   # kind of the rows that carry the totals
ROW = "chunk long, bucket int, kind int, a binary, b binary, stats array<long>"


def start_key(n: int) -> np.uint64:
    """Key of the run of n start words."""
    return _keys([np.array([START])] * n)[0]


def _keys(words: list[np.ndarray]) -> np.ndarray:
    """Keys of runs of words, given their last words, the words before, ..."""
    if len(words) == 1:
        return words[0]
    value = words[-1]
    for w in words[-2::-1]:
        value = value * BASE + w
    return mix(value)


#: Is a byte part of a word?
INSIDE = np.array([not (c == 32 or 9 <= c <= 13) for c in range(256)])
SHORT = 32


def word_keys(docs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit keys of all words of the documents in a row, A-Z lowered; number
    of words of each). A word's key is a polynomial in its bytes and length,
    stepped for all words at once, byte by byte; words above ``SHORT`` bytes,
    which are rare, are hashed one by one."""
    from xxhash import xxh64_intdigest
    joined = b"\n".join(d.lower() for d in docs)
    text = np.frombuffer(joined, np.uint8)
    edge = np.diff(INSIDE[text].astype(np.int8), prepend=0, append=0)
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    size = end - begin
    keys = size.astype(np.uint64)
    live = np.flatnonzero(size <= SHORT)
    for k in range(SHORT):
        live = live[size[live] > k]
        keys[live] = keys[live] * BASE + text[begin[live] + k]
    for i in np.flatnonzero(size > SHORT).tolist():
        keys[i] = xxh64_intdigest(joined[begin[i]:end[i]], 7)
    first = np.cumsum([0] + [len(d) + 1 for d in docs])       # where each document starts
    return mix(keys), np.diff(np.searchsorted(begin, first)).astype(np.int64)


class Tokens:
    """Keys of a chunk's runs of words. At index n of each list: the distinct
    runs of n words (sorted keys), which of them ends at each place, and of
    each distinct run its history (a run of n - 1), its last n - 1 words and
    whether it has a token (the start words before a text have none)."""

    def __init__(self, docs: list[bytes], order: int):
        words, counts = word_keys(docs)
        self.sizes = counts + 2
        begin = np.cumsum(self.sizes) - self.sizes
        self.counts = self.sizes - 1
        flat = np.full(int(self.sizes.sum()), START)
        flat[begin + counts + 1] = END
        flat[np.arange(len(words)) + 2 * np.repeat(np.arange(len(counts)), counts) + 1] = words
        self.token = np.ones(len(flat), bool)
        self.token[begin] = False
        self.runs, self.run_of, self.history, self.shorter, self.real = [None], [None], [None], [None], [None]
        words = []
        for n in range(1, order + 1):
            if n == 1:
                words.append(flat)
            else:
                before = np.empty_like(flat)
                before[1:] = words[-1][:-1]
                before[begin] = START
                words.append(before)
            runs, first, which = numbered(_keys(words))
            self.runs.append(runs)
            self.run_of.append(which)
            self.real.append(runs != start_key(n))
            self.history.append(self.run_of[n - 1][first - 1] if n > 1 else None)  # of no use where not real
            self.shorter.append(self.run_of[n - 1][first] if n > 1 else None)

    def trained(self, train: np.ndarray) -> list[np.ndarray]:
        """Training counts of the distinct runs of 1, 2, ... words."""
        on = np.repeat(train, self.sizes)
        return [np.bincount(w[on], minlength=len(r)) for w, r in zip(self.run_of[1:], self.runs[1:])]


def discounts(n: np.ndarray) -> np.ndarray:
    """Good-Turing discounts d[0..K] from the counts of counts n[1..K+1]; 1
    where they are not defined or not between 0 and 1."""
    d = np.ones(K + 1)
    common = (K + 1) * n[K + 1] / n[1] if n[1] else 1.0
    if 0 < common < 1:
        for r in range(1, K + 1):
            if n[r] and n[r + 1]:
                x = ((r + 1) * n[r + 1] / (r * n[r]) - common) / (1 - common)
                d[r] = x if 0 < x <= 1 else 1.0
    return d


class Model:
    """N, V and for each n the discounts, from the sums of all buckets."""

    def __init__(self, stats: list[int]):
        self.n, self.v = stats[:2]
        self.d = [None, None, *[discounts(np.array([0, *stats[k:k + K + 1]])) for k in range(2, len(stats), K + 1)]]

    def base(self, words, runs=1):
        """Sum of P(w) over so many words with so many training tokens."""
        return (words + 0.5 * runs) / (self.n + 0.5 * (self.v + 1))


def _framed(blobs) -> bytes:
    return b"".join(len(x).to_bytes(4, "little") + x for x in blobs)


def _frames(blob: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(blob):
        n = int.from_bytes(blob[at:at + 4], "little")
        out.append(blob[at + 4:at + 4 + n])
        at += 4 + n
    return out


def _rows(chunks, buckets, kind, a, b, stats):
    """Packed rows, one for each chunk and bucket; a and b are lists of blobs."""
    n = len(a)
    return pa.table({"chunk": pa.array(chunks, pa.int64()), "bucket": pa.array(buckets, pa.int32()),
                     "kind": pa.array([kind] * n, pa.int32()), "a": pa.array(map(_framed, a), pa.binary()),
                     "b": pa.array(map(_framed, b), pa.binary()), "stats": pa.array([stats] * n, pa.list_(pa.int64()))})


def score(df: DataFrame, train_col: str, id_col: str = "doc_id", text_col: str = "text",
          order: int = 2, tables: str | None = None, drop_text: bool = False) -> DataFrame:
    """Learns runs of up to ``order`` words from the rows where ``train_col``
    is true and scores all rows: n_tokens, n_known (c > 0), train_tokens (N),
    base_score (single words) and score (Katz), log10 probabilities of the
    whole text. With ``tables``, a folder that all machines share, the counts
    are also written there at once, as parquet with the columns run (key) and
    count in a folder for each n; files are ranges of keys."""
    check_columns(df, id_col, text_col, train_col)
    if order < 2:
        raise ValueError("order must be 2 at least")
    bounded_batches(df.sparkSession)
    least = parts(df.sparkSession)
    size = int(df.agg(F.sum(F.octet_length(text_col))).first()[0] or 0)
    n_chunks, n_buckets = (max(least, -(-size // x)) for x in sizes(size))
    longer = range(2, order + 1)

    def place(batch, hashes, nth):
        """Rows by their hash; equal rows one chunk after the other."""
        chunk = ((hashes.view(np.uint64) % np.uint64(n_chunks)).astype(np.int64) + nth) % n_chunks
        return chunk, chunk

    docs = dealt(df, text_col, place).drop(RANK)

    def tokens_of(table):
        return Tokens(dealt_texts(table.column(text_col)), order)

    def held(t):
        """The buckets of a chunk's runs, rising."""
        return np.unique(np.concatenate([bucket_edges(r, n_buckets)[0] for r in t.runs[1:]]))

    def cut(keys, values, how, buckets):
        """Blobs of the values (aligned with sorted keys), one a bucket."""
        return [how(values[a:b]) for a, b in zip(*spans(keys, n_buckets, buckets))]

    def lists(key, table):
        """The chunk's runs with its training counts, a row for each bucket of
        them."""
        t = tokens_of(table)
        train = np.array([bool(x) for x in table.column(train_col).to_pylist()], bool)
        buckets = held(t)
        keys = [cut(r, r, pack, buckets) for r in t.runs[1:]]
        counts = [cut(r, c.astype(np.uint32), squeeze, buckets) for r, c in zip(t.runs[1:], t.trained(train))]
        return _rows([key[0].as_py()] * len(buckets), buckets, 0, list(zip(*keys)), list(zip(*counts)), [])

    def added(n, keys, counts):
        """A bucket's runs of n words: those of each chunk, the distinct ones,
        a place of each, which is which, and their training counts."""
        own = [unpack(x[n - 1]) for x in keys]
        distinct, first, which = numbered(np.concatenate(own))
        total = np.bincount(which, np.concatenate([stretch(x[n - 1], np.uint32) for x in counts]), len(distinct))
        return own, distinct, first, which, total.astype(np.int64)

    def table_of(key, table):
        """The rows of a bucket's count tables."""
        keys, counts = ([_frames(x) for x in table.column(c).to_pylist()] for c in "ab")
        made = []
        for n in range(1, order + 1):
            _, runs, _, _, total = added(n, keys, counts)
            on = (total > 0) & (runs != start_key(n))
            made.append(pa.table({"n": pa.array([n] * int(on.sum()), pa.int32()),
                                  "run": pa.array(runs[on].view(np.int64)), "count": pa.array(total[on])}))
        return pa.concat_tables(made)

    def totals(key, table):
        """Totals of a bucket's runs, and which of them a chunk is the first to
        list, answered to every chunk."""
        table = table.sort_by("chunk")
        keys = [_frames(x) for x in table.column("a").to_pylist()]
        counts = [_frames(x) for x in table.column("b").to_pylist()]
        sums, firsts = [], []
        for n in range(1, order + 1):
            own, distinct, first, which, total = added(n, keys, counts)
            cuts = np.cumsum([len(x) for x in own])[:-1]
            sums.append([squeeze(x) for x in np.split(total[which].astype(np.uint32), cuts)])
            if n > 1:
                lists_first = np.zeros(len(which), bool)
                lists_first[first] = True
                firsts.append([squeeze(np.packbits(x)) for x in np.split(lists_first, cuts)])
        return _rows(table.column("chunk").to_pylist(), table.column("bucket").to_pylist(), 1,
                     list(zip(*sums)), list(zip(*firsts)), [])

    def counts_of_counts(key, table):
        """Training tokens and words of a bucket, and for each longer n how many
        of its runs have count 1 to K + 1."""
        keys, counts = ([_frames(x) for x in table.column(c).to_pylist()] for c in "ab")
        stats = []
        for n in range(1, order + 1):
            _, distinct, _, _, total = added(n, keys, counts)
            real = total[distinct != start_key(n)]
            stats += [int(real.sum()), int((real > 0).sum())] if n == 1 else \
                [int((real == r).sum()) for r in range(1, K + 2)]
        return pa.table({"stats": pa.array([stats], pa.list_(pa.int64()))})

    class Known:
        """What a chunk's answers say about its runs."""

        def __init__(self, t: Tokens, table):
            import pyarrow.compute as pc
            self.stats = table.filter(pc.equal(table.column("kind"), STATS)).column("stats")[0].as_py()
            self.model = Model(self.stats)
            rows = table.filter(pc.equal(table.column("kind"), 1)).sort_by("bucket")
            buckets = held(t)
            sums, firsts = ([_frames(x) for x in rows.column(c).to_pylist()] for c in "ab")
            self.total, self.first, self.wanted = [None], [None, None], [None, None]
            for n in range(1, order + 1):
                self.total.append(np.concatenate([stretch(x[n - 1], np.uint32) for x in sums]).astype(np.int64))
            for n in longer:
                begin, end = spans(t.runs[n], n_buckets, buckets)
                self.first.append(np.concatenate([np.unpackbits(stretch(x[n - 2], np.uint8), count=m).astype(bool)
                                                  for x, m in zip(firsts, end - begin)]))
                # histories that training saw, but not before a word that follows them here
                wanted = np.zeros(len(t.runs[n - 1]), bool)
                wanted[t.history[n][t.real[n] & (self.total[n] == 0)]] = True
                self.wanted.append(wanted & (self.total[n - 1] > 0))

    def histories(key, table, answers):
        """For runs that this chunk lists first, by history: how many have
        count 1 to K, the sum of their counts, and what their shorter runs'
        probabilities add up from; and which histories need alpha here."""
        if not table.num_rows:
            return _rows([], [], 2, [], [], [])
        t = tokens_of(table)
        known = Known(t, answers)
        buckets = held(t)
        body, need = [], []
        for n in longer:
            runs, size = t.runs[n - 1], len(t.runs[n - 1])
            own = known.first[n] & (known.total[n] > 0) & t.real[n]
            h, c, low = t.history[n][own], known.total[n][own], known.total[n - 1][t.shorter[n][own]]

            def summed(values):
                out = np.zeros(size, np.uint64)
                np.add.at(out, h[values > 0], values[values > 0].astype(np.uint64))
                return out

            few = [np.bincount(h[c == r], minlength=size).astype(np.uint32) for r in range(1, K + 1)]
            if n == 2:
                few.append(np.bincount(h, minlength=size).astype(np.uint32))
                sums = [summed(c), summed(low)]
            else:
                few += [np.bincount(h[low == r], minlength=size).astype(np.uint32) for r in range(1, K + 1)]
                sums = [summed(c), summed(np.where(low > K, low, 0))]
            body += [cut(runs, x, squeeze, buckets) for x in [*few, *sums]]
            need.append(cut(runs, known.wanted[n].astype(np.uint8), squeeze, buckets))
        return _rows([key[0].as_py()] * len(buckets), buckets, 2, list(zip(*body)), list(zip(*need)), known.stats)

    def history_totals(key, listed, table):
        """For every chunk: which of its histories have no discounted count,
        and, of those that need alpha, alpha itself (n = 2) or what it keeps
        back and the sum of the shorter runs' counts (its denominator is known
        to the chunk)."""
        listed, table = listed.sort_by("chunk"), table.sort_by("chunk")
        keys = [_frames(x) for x in listed.column("a").to_pylist()]
        planes = [_frames(x) for x in table.column("a").to_pylist()]
        need = [_frames(x) for x in table.column("b").to_pylist()]
        model = Model(table.column("stats")[0].as_py())
        flags, values, at = [], [], 0
        for n in longer:
            own = [unpack(x[n - 2]) for x in keys]
            distinct, _, which = numbered(np.concatenate(own))
            cuts = np.cumsum([len(x) for x in own])[:-1]

            def total(plane, kind):
                made = np.zeros(len(distinct), np.int64)
                parts_ = np.concatenate([stretch(x[plane], kind) for x in planes])
                on = np.flatnonzero(parts_)
                np.add.at(made, which[on], parts_[on].astype(np.int64))
                return made

            d, few = model.d[n], K + 1 if n == 2 else 2 * K
            count = [total(at + r, np.uint32) for r in range(few)]
            c, low = total(at + few, np.uint64), total(at + few + 1, np.uint64)
            at += few + 2
            kept_back = sum((1 - d[r]) * r * count[r - 1] for r in range(1, K + 1))
            none = kept_back <= 1e-9 * c
            reserve = np.where(none, 1.0, kept_back) / (c + none)
            if n == 2:
                made = [reserve / np.maximum(1 - model.base(low, count[K]), 1e-300)]
            else:
                made = [reserve, low + sum(model.d[n - 1][r] * r * count[K + r - 1] for r in range(1, K + 1))]
            wanted = [stretch(x[n - 2], np.uint8).astype(bool) for x in need]
            flags.append([squeeze(np.packbits(x)) for x in np.split(none[which], cuts)])
            values += [[squeeze(x[w]) for x, w in zip(np.split(m[which], cuts), wanted)] for m in made]
        return _rows(table.column("chunk").to_pylist(), table.column("bucket").to_pylist(), 3,
                     list(zip(*flags)), list(zip(*values)), [])

    new = "n_tokens long, n_known long, train_tokens long, base_score double, score double"
    out_ddl = schema_with(df, new, (text_col,) if drop_text else ())

    def probabilities(t, known, rows):
        """P of each distinct run's last word after the others, for the runs of
        1 and of ``order`` words."""
        flags, values = ([_frames(x) for x in rows.column(c).to_pylist()] for c in "ab")
        model = known.model
        p, z, at, buckets = [None, model.base(known.total[1])], [None], 0, held(t)
        base = p[1]
        for n in longer:
            begin, end = spans(t.runs[n - 1], n_buckets, buckets)
            none = np.concatenate([np.unpackbits(stretch(x[n - 2], np.uint8), count=m)
                                   for x, m in zip(flags, end - begin)])
            z.append(known.total[n - 1] + none)
            made = [np.concatenate([stretch(x[at + k], np.float64) for x in values]) for k in range(1 if n == 2 else 2)]
            at += len(made)
            alpha, on = np.ones(len(none)), known.wanted[n]
            if n == 2:
                alpha[on] = made[0]
            else:
                seen = made[1] / np.maximum(z[n - 2][t.shorter[n - 1][on]], 1)
                alpha[on] = made[0] / np.maximum(1 - seen, 1e-300)
            c, h = known.total[n], t.history[n]
            direct = model.d[n][np.minimum(c, K) * (c <= K)] * c / np.maximum(z[n - 1][h], 1)
            p.append(np.where(c > 0, direct, alpha[h] * p[n - 1][t.shorter[n]]))
        return base, p[order]

    def scored(key, table, answers):
        import pyarrow.compute as pc
        table = table.drop_columns([CHUNK])
        t = tokens_of(table)
        if drop_text:
            table = table.drop_columns([text_col])
        else:
            null = table.column(text_col).is_null().to_pylist()
            back = [None if n else x.decode() for x, n in zip(dealt_texts(table.column(text_col)), null)]
            at = table.column_names.index(text_col)
            table = table.set_column(at, text_col, pa.array(back, pa.string()))
        m = len(t.counts)
        if m:
            known = Known(t, answers)
            base, p = probabilities(t, known, answers.filter(pc.equal(answers.column("kind"), 3)).sort_by("bucket"))
            doc = np.repeat(np.arange(m), t.counts)
            word, run = t.run_of[1][t.token], t.run_of[order][t.token]
            result = {"n_tokens": pa.array(t.counts),
                      "n_known": pa.array(np.bincount(doc, known.total[1][word] > 0, m).astype(np.int64)),
                      "train_tokens": pa.array([known.model.n] * m, pa.int64()),
                      "base_score": pa.array(np.bincount(doc, np.log10(base)[word], m)),
                      "score": pa.array(np.bincount(doc, np.log10(p)[run], m))}
        else:
            result = {f.split()[0]: pa.array([], {"long": pa.int64(), "double": pa.float64()}[f.split()[1]])
                      for f in new.split(", ")}
        rest = [c for c in table.column_names if c not in result]
        return pa.table({c: table.column(c) for c in rest} | result)

    by_chunk = docs.groupBy(CHUNK)
    listed = by_chunk.applyInArrow(lists, ROW).groupBy("bucket")
    if tables:
        listed.applyInArrow(table_of, "n int, run long, count long").write.partitionBy("n").parquet(tables)
    # totals over all buckets, one row that every chunk receives
    width = 2 + (K + 1) * (order - 1)
    summed = listed.applyInArrow(counts_of_counts, "stats array<long>").agg(
        F.array(*[F.coalesce(F.sum(F.col("stats")[i]), F.lit(0)) for i in range(width)]).alias("stats"))
    everywhere = summed.select(F.explode(F.sequence(F.lit(0), F.lit(n_chunks - 1)).cast("array<long>")).alias("chunk"),
                               F.lit(0).alias("bucket"), F.lit(STATS).alias("kind"), F.lit(b"").alias("a"),
                               F.lit(b"").alias("b"), "stats")
    counted = listed.applyInArrow(totals, ROW).unionAll(everywhere)
    sums = listed.cogroup(by_chunk.cogroup(counted.groupBy("chunk")).applyInArrow(histories, ROW).groupBy("bucket")) \
        .applyInArrow(history_totals, ROW)
    return by_chunk.cogroup(counted.unionAll(sums).groupBy("chunk")).applyInArrow(scored, out_ddl)
