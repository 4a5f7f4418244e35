"""Byte-level BPE encoding and decoding (operator 1).

Pre-tokenisation needs no regular expression. Every code point gets a class
(letter, number, other, kinds of white space, kinds of apostrophe); the
splitting pattern is an automaton of eight states over these classes. The
class of a position is a function from states to states, and composing such
functions is associative, so the state at every position of a batch comes from
a blocked prefix scan: rows of the batch are scanned side by side with array
operations, then the rows' total functions, then the rows again from their
true first state. Token slices start where the automaton says so. Each
distinct slice is merged once per worker (cached pair merging).

Defined cases: a null or empty text has no ids and decodes to no bytes; extra
columns pass through; output columns replace input columns of the same name;
repeated rows are encoded each; no text is cut.
"""

from __future__ import annotations

import base64
import heapq
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import bounded_batches, check_columns, schema_with, slices, texts, with_columns

# classes of code points, then those that depend on what follows
LETTER, NUMBER, OTHER, QUOTE1, QUOTE2, SPACE_RUN, BLANK, SPACE_END, TEXT_END = range(9)
UNKNOWN = 255
# states: what the token that is open at a position may go on with
CLOSED, IN_LETTERS, IN_NUMBERS, IN_OTHER, AFTER_BLANK, IN_SPACE, ONE_MORE, TWO_MORE = range(8)


def _automaton() -> tuple[np.ndarray, np.ndarray]:
    """(next state, does a token start here) by class and state."""
    step = np.zeros((9, 8), np.uint8)
    start = np.ones((9, 8), bool)
    for s in range(8):
        step[LETTER, s] = IN_LETTERS
        step[NUMBER, s] = IN_NUMBERS
        step[OTHER, s] = IN_OTHER
        step[QUOTE1, s], step[QUOTE2, s] = ONE_MORE, TWO_MORE
        step[SPACE_RUN, s] = IN_SPACE
        step[BLANK, s] = AFTER_BLANK
        step[SPACE_END, s] = step[TEXT_END, s] = CLOSED
    # a run of one class, or a blank before it, is one token
    for cls, run in ((LETTER, IN_LETTERS), (NUMBER, IN_NUMBERS), (OTHER, IN_OTHER)):
        start[cls, [run, AFTER_BLANK]] = False
    # an apostrophe inside other signs or after a blank belongs to them
    for cls in (QUOTE1, QUOTE2):
        step[cls, [IN_OTHER, AFTER_BLANK]] = IN_OTHER
        start[cls, [IN_OTHER, AFTER_BLANK]] = False
    # the letters of a contraction
    step[LETTER, ONE_MORE], start[LETTER, ONE_MORE] = CLOSED, False
    step[LETTER, TWO_MORE], start[LETTER, TWO_MORE] = ONE_MORE, False
    start[SPACE_RUN, IN_SPACE] = False
    return step, start


STEP, START = _automaton()


def _closure(step: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All functions that compositions of the classes' functions give: their
    tables, and the table of compositions. Number 0 to 8 are the classes',
    the last is the identity."""
    found = [tuple(int(x) for x in row) for row in step]
    known = {f: i for i, f in reversed(list(enumerate(found)))}
    k = 0
    while k < len(found):
        for g in step:
            h = tuple(int(g[s]) for s in found[k])
            if h not in known:
                known[h] = len(found)
                found.append(h)
        k += 1
    found.append(tuple(range(8)))
    known.setdefault(found[-1], len(found) - 1)
    after = np.array([[known[tuple(g[s] for s in f)] for g in found] for f in found], np.uint16)
    return np.array(found, np.uint8), after


FUNCTIONS, COMPOSE = _closure(STEP)
IDENTITY = len(FUNCTIONS) - 1


def _prefix(functions: np.ndarray) -> np.ndarray:
    """Exclusive prefix compositions of an array of function numbers."""
    n, width = len(functions), len(FUNCTIONS)
    inclusive, gap = functions.copy(), 1
    while gap < n:
        nxt = inclusive.copy()
        nxt[gap:] = COMPOSE.ravel().take(inclusive[:-gap].astype(np.int64) * width + inclusive[gap:])
        inclusive, gap = nxt, gap * 2
    out = np.empty_like(inclusive)
    out[:1], out[1:] = IDENTITY, inclusive[:-1]
    return out


def scan(classes: np.ndarray, columns: int = 256) -> np.ndarray:
    """Where tokens start: a boolean for every position."""
    n = len(classes)
    if not n:
        return np.zeros(0, bool)
    rows = -(-n // columns)
    grid = np.full(rows * columns, TEXT_END, np.uint8)
    grid[:n] = classes
    grid = np.ascontiguousarray(grid.reshape(rows, columns).T)
    width, table = len(FUNCTIONS), COMPOSE.ravel()
    total = grid[0].astype(np.uint16)
    for k in range(1, columns):
        total = table.take(total.astype(np.int32) * width + grid[k])
    state = FUNCTIONS[_prefix(total), CLOSED]
    starts = np.empty(grid.shape, bool)
    step, start = STEP.ravel(), START.ravel()
    for k in range(columns):
        at = grid[k].astype(np.int16) * 8 + state
        starts[k] = start.take(at)
        state = step.take(at)
    return starts.T.reshape(-1)[:n]


class Classes:
    """Letter, number, white space or other by code point, looked up once for
    each code point that occurs, in the tokenizer library's Unicode tables."""

    def __init__(self):
        self.table = np.full(0x110000, UNKNOWN, np.uint8)

    def learn(self, points: np.ndarray) -> None:
        import tiktoken
        single = {bytes([i]): i for i in range(256)}
        chars = "".join(map(chr, points))
        self.table[points] = OTHER
        for cls, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE_RUN, r"\s+")):
            enc = tiktoken.Encoding("class", pat_str=pattern, mergeable_ranks=single, special_tokens={})
            has = bytes(enc.encode_ordinary(chars)).decode()
            self.table[np.frombuffer(has.encode("utf-32-le"), np.uint32)] = cls

    def of(self, points: np.ndarray) -> np.ndarray:
        cls = self.table.take(points)
        if (cls == UNKNOWN).any():
            self.learn(np.unique(points[cls == UNKNOWN]))
            cls = self.table.take(points)
        return cls


def token_starts(joined: str, ends: np.ndarray, classes: Classes) -> np.ndarray:
    """Start flags over texts joined by one character each; ``ends`` are the
    places of these characters (one after every text)."""
    cp = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    cls = classes.of(cp).copy()
    cls[ends] = TEXT_END
    white = cls == SPACE_RUN
    goes_on = np.ones(len(cp), bool)
    goes_on[:-1] = white[1:] | (cls[1:] == TEXT_END)
    last = white & ~goes_on
    cls[last] = np.where(cp[last] == 0x20, BLANK, SPACE_END)
    quote = np.flatnonzero((cp == 0x27) & (cls == OTHER))
    if len(quote):
        pad = np.concatenate([cp, np.zeros(2, np.uint32)])
        a, b = pad[quote + 1], pad[quote + 2]
        one = np.isin(a, [ord(c) for c in "stmd"])
        two = np.zeros(len(quote), bool)
        for pair in ("re", "ve", "ll"):
            two |= (a == ord(pair[0])) & (b == ord(pair[1]))
        cls[quote[one]], cls[quote[two]] = QUOTE1, QUOTE2
    return scan(cls)


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one slice: the adjacent pair of lowest rank (leftmost first) is
    merged until no pair has a rank. A heap keeps long slices near linear."""
    if piece in ranks:
        return [ranks[piece]]
    n = len(piece)
    if n <= 48:
        cut = list(range(n + 1))
        rank = [ranks.get(piece[i:i + 2], 1 << 30) for i in range(n - 1)]
        while rank and (low := min(rank)) < 1 << 30:
            i = rank.index(low)
            del cut[i + 1], rank[i]
            if i < len(rank):
                rank[i] = ranks.get(piece[cut[i]:cut[i + 2]], 1 << 30)
            if i:
                rank[i - 1] = ranks.get(piece[cut[i - 1]:cut[i + 1]], 1 << 30)
        return [ranks[piece[a:b]] for a, b in zip(cut, cut[1:])]
    end = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    alive = [True] * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i:i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        if not alive[i] or end[i] >= n or end[end[i]] != stop:
            continue
        j = end[i]
        alive[j] = False
        end[i] = stop
        if stop < n:
            before[stop] = i
            if (r := ranks.get(piece[i:end[stop]])) is not None:
                heapq.heappush(heap, (r, i, end[stop]))
        if (h := before[i]) >= 0 and (r := ranks.get(piece[h:stop])) is not None:
            heapq.heappush(heap, (r, h, stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i:end[i]]])
        i = end[i]
    return out


class Encoder(dict):
    """Slice -> its ids as int32 bytes; filled on demand, emptied when its slices
    take ``most`` bytes (their objects included), so that a worker's memory stays
    bounded. Slices above ``LONGEST`` characters, which hardly come again, are not
    kept."""

    LONGEST = 64
    #: Bytes of a dictionary entry and its two objects, besides what they hold.
    ENTRY = 200

    def __init__(self, vocab: str, most: int = 32 << 20):
        super().__init__()
        self.most, self.held, self.classes = most, 0, Classes()
        with open(vocab, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        size = max(self.ranks.values()) + 1
        pieces = [b""] * size
        for piece, rank in self.ranks.items():
            pieces[rank] = piece
        self.lengths = np.array([len(p) for p in pieces], np.int64)
        self.begins = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])
        self.flat = np.frombuffer(b"".join(pieces), np.uint8)

    def __missing__(self, piece: str) -> bytes:
        ids = np.array(merge(piece.encode(), self.ranks), np.int32).tobytes()
        if len(piece) <= self.LONGEST and self.held < self.most:
            self[piece] = ids
            self.held += self.ENTRY + 4 * len(piece) + len(ids)
        return ids

    def encode(self, batch: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and where each text's ids end."""
        if self.held >= self.most:
            self.clear()
            self.held = 0
        joined = "\n".join(batch) + "\n"
        ends = np.cumsum([len(t) + 1 for t in batch]) - 1
        begins = np.flatnonzero(token_starts(joined, ends, self.classes))
        at = begins.tolist()
        pieces = [joined[a:b] for a, b in zip(at, at[1:] + [len(joined)])]
        closing = np.searchsorted(begins, ends)  # the joining characters' own slices
        for k in closing.tolist():
            pieces[k] = None
        got = [b"" if p is None else self[p] for p in pieces]
        upto = np.cumsum(np.fromiter(map(len, got), np.int64, len(got))) // 4
        return np.frombuffer(b"".join(got), np.int32), upto[closing]

    def decode(self, ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Bytes of ids whose first bytes are at ``starts``."""
        lengths = self.lengths[ids]
        total = int(lengths.sum())
        source = np.repeat(self.begins[ids] - starts, lengths)
        source += np.arange(total)
        return self.flat[source]


@lru_cache(maxsize=4)
def encoder(vocab: str) -> Encoder:
    return Encoder(vocab)


def encode(df: DataFrame, vocab: str, text_col: str = "text", drop_text: bool = False) -> DataFrame:
    """Adds ``ids`` (array<int>) and ``starts`` (array<int>: the byte offset of
    every id in the text's UTF-8 bytes). ``vocab`` is the path of a rank file
    that every executor can read."""
    check_columns(df, text_col)
    bounded_batches(df.sparkSession)

    def run(batches):
        enc = encoder(vocab)
        for whole in batches:
            for batch in slices(whole, text_col):
                ids, upto = enc.encode(texts(batch.column(text_col)))
                begin = np.concatenate([[0], upto[:-1]])
                place = np.cumsum(enc.lengths[ids]) - enc.lengths[ids]
                first = np.concatenate([place, [0]])[np.minimum(begin, len(ids))]
                starts = place - np.repeat(first, upto - begin)
                offsets = pa.array(np.concatenate([[0], upto]).astype(np.int32))
                out = with_columns(batch, {
                    "ids": pa.ListArray.from_arrays(offsets, pa.array(ids)),
                    "starts": pa.ListArray.from_arrays(offsets, pa.array(starts.astype(np.int32)))})
                yield out.drop_columns([text_col]) if drop_text else out

    return df.mapInArrow(run, schema_with(df, "ids array<int>, starts array<int>",
                                          (text_col,) if drop_text else ()))


def decode(df: DataFrame, vocab: str, out_col: str = "decoded") -> DataFrame:
    """Adds the bytes (binary) of ``ids``; ``starts`` places them. Null ids
    decode to no bytes."""
    check_columns(df, "ids", "starts")
    bounded_batches(df.sparkSession)

    def run(batches):
        enc = encoder(vocab)
        for batch in batches:
            ids, starts = batch.column("ids"), batch.column("starts")
            made = []
            for a, b in zip(ids, starts):
                x = np.asarray(a.values) if a.is_valid else np.zeros(0, np.int32)
                y = np.asarray(b.values) if b.is_valid else np.zeros(0, np.int32)
                made.append(enc.decode(x, y).tobytes() if len(x) else b"")
            yield with_columns(batch, {out_col: pa.array(made, pa.binary())})

    return df.mapInArrow(run, schema_with(df, f"{out_col} binary"))


def count_tokens(df: DataFrame, vocab: str, text_col: str = "text", out_col: str = "n_tokens") -> DataFrame:
    """Replaces the text by the number of its ids (long)."""
    check_columns(df, text_col)
    bounded_batches(df.sparkSession)

    def run(batches):
        enc = encoder(vocab)
        for whole in batches:
            for batch in slices(whole, text_col):
                _, upto = enc.encode(texts(batch.column(text_col)))
                counts = np.diff(upto, prepend=0)
                yield with_columns(batch.drop_columns([text_col]), {out_col: pa.array(counts, pa.int64())})

    return df.mapInArrow(run, schema_with(df, f"{out_col} long", (text_col,)))
