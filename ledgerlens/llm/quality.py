"""Quality rules as a short-circuit cascade (operator 4).

Each rule rejects a text or lets it pass. On a bounded sample every rule is
run alone and timed; rules are then ordered by rejections per second, so that
cheap rules that reject much go first and a rejected text meets no further
rule. The verdict (no rule rejects) does not depend on the order.

Defined cases: a null or empty text has no words, so it is rejected
(``few_words``); repeated rows are judged each; extra columns pass through and
output columns replace input columns of the same name; whole texts are read.
"""

from __future__ import annotations

import time
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WHITE, bounded_batches, check_columns, schema_with, slices, text_bytes, with_columns

SYMBOLS = b"#*$%&|<>"
SAMPLE_ROWS = 2000


def repeated_words(ids: np.ndarray, distinct: int, width: int = 5) -> int:
    """Words that lie in a window of ``width`` words found twice or more (first
    included). ``ids`` number the words; equal windows are found exactly."""
    n = len(ids)
    if n < width + 1 or distinct == n:
        return 0
    key, base = ids, distinct
    for k in range(1, width):
        if base * distinct >= 1 << 62:  # number the windows so far anew
            seen, key = np.unique(key, return_inverse=True)
            base = len(seen)
        m = n - k
        key = key[:m] * distinct + ids[k:]
        base *= distinct
    _, inverse, counts = np.unique(key, return_inverse=True, return_counts=True)
    again = counts[inverse] > 1
    if not again.any():
        return 0
    edge = np.zeros(n + 1, np.int64)
    edge[:len(again)] += again
    edge[width:width + len(again)] -= again
    return int((np.cumsum(edge)[:n] > 0).sum())


class Measures:
    """Measures of one text, each made when a rule first asks for it."""

    def __init__(self, text: bytes):
        self.text = text

    @cached_property
    def words(self) -> list[bytes]:
        return self.text.split()

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        """Code points in words: bytes in words without continuation bytes."""
        joined = b"".join(self.words)
        return len(joined) if joined.isascii() else len(joined.decode())

    @cached_property
    def n_symbols(self) -> int:
        return sum(self.text.count(SYMBOLS[i:i + 1]) for i in range(len(SYMBOLS)))

    @cached_property
    def lines(self) -> list[bytes]:
        """Lines that hold a word."""
        return [x for x in self.text.split(b"\n") if x.strip(WHITE)]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def ids(self) -> tuple[np.ndarray, int]:
        number: dict[bytes, int] = {}
        ids = [number.setdefault(w, len(number)) for w in self.words]
        return np.array(ids, np.int64), len(number)

    @cached_property
    def n_repeat_words(self) -> int:
        return repeated_words(*self.ids)

    @cached_property
    def n_stutters(self) -> int:
        """Words equal to the word before them."""
        ids = self.ids[0]
        return int((ids[1:] == ids[:-1]).sum())

    @cached_property
    def n_lettered(self) -> int:
        """Words that hold a letter or a character beyond ASCII."""
        return sum(not w.isascii() or w.lower() != w.upper() for w in self.words)


#: A rule is true for a text that it rejects.
RULES = {
    "few_words": lambda m: m.n_words < 10,
    "repeats": lambda m: 100 * m.n_repeat_words > 20 * m.n_words,
    "symbols": lambda m: 10 * m.n_symbols > m.n_words,
    "word_length": lambda m: not 3 * m.n_words <= m.word_chars <= 10 * m.n_words,
    "dup_lines": lambda m: 10 * m.n_dup_lines > 7 * len(m.lines),
    "stutter": lambda m: 5 * m.n_stutters > m.n_words,
    "no_letters": lambda m: 2 * m.n_lettered < m.n_words,
}
BASE_RULES = ("few_words", "repeats")


def rule_costs(df: DataFrame, text_col: str = "text", rules: dict = RULES,
               sample_rows: int = SAMPLE_ROWS, seed: int = 17) -> dict[str, tuple[float, float]]:
    """(seconds a text, share rejected) of each rule on a seeded sample of
    about ``sample_rows`` texts. One row for each rule and task reaches the
    driver after Spark has summed them."""
    rows = df.count()
    sample = df.select(text_col).sample(fraction=min(1.0, sample_rows / max(rows, 1)), seed=seed)

    def run(batches):
        spent, hits, n = dict.fromkeys(rules, 0.0), dict.fromkeys(rules, 0), 0
        for batch in batches:
            for text in text_bytes(batch.column(text_col)):
                n += 1
                for name, rule in rules.items():
                    began = time.perf_counter()
                    hits[name] += bool(rule(Measures(text)))
                    spent[name] += time.perf_counter() - began
        yield pa.RecordBatch.from_pydict({"rule": list(rules), "spent": list(spent.values()),
                                          "hits": list(hits.values()), "n": [n] * len(rules)})

    got = (sample.mapInArrow(run, "rule string, spent double, hits long, n long")
           .groupBy("rule").agg(F.sum("spent"), F.sum("hits"), F.sum("n")).collect())
    return {r[0]: (r[1] / max(r[3], 1), r[2] / max(r[3], 1)) for r in got}


def rule_order(costs: dict[str, tuple[float, float]], rules: dict = RULES) -> list[str]:
    """Rules by rejections per second, most first; unmeasured rules last."""
    gain = {k: costs[k][1] / max(costs[k][0], 1e-9) if k in costs else -1.0 for k in rules}
    return sorted(rules, key=lambda k: -gain[k])


def cascade(df: DataFrame, text_col: str = "text", rules: dict = RULES,
            order: list[str] | None = None, measures: bool = False, out_col: str = "kept") -> DataFrame:
    """Adds ``out_col`` (no rule rejects). With ``measures`` also the numbers
    n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and
    ``base_failed`` (one of BASE_RULES rejects). ``order``: that of the rules;
    by default found on a sample."""
    check_columns(df, text_col)
    bounded_batches(df.sparkSession)
    steps = [rules[k] for k in (order or rule_order(rule_costs(df, text_col, rules), rules))]
    base = [rules[k] for k in BASE_RULES if k in rules]
    numbers = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

    def run(batches):
        for whole in batches:
            for batch in slices(whole, text_col):
                made = [Measures(t) for t in text_bytes(batch.column(text_col))]
                new = {}
                if measures:
                    for name in numbers:
                        new[name] = pa.array([getattr(m, name) for m in made], pa.int64())
                    new["base_failed"] = pa.array([any(r(m) for r in base) for m in made], pa.bool_())
                new[out_col] = pa.array([not any(r(m) for r in steps) for m in made], pa.bool_())
                yield with_columns(batch, new)

    ddl = f"{out_col} boolean"
    if measures:
        ddl = ", ".join(f"{n} long" for n in numbers) + ", base_failed boolean, " + ddl
    return df.mapInArrow(run, schema_with(df, ddl))


def filter_quality(df: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The rows that every rule lets pass, with the columns they came with."""
    judged = cascade(df, text_col, out_col="__kept", **options)
    return judged.where("__kept").select(*df.columns)
