"""Scalar Column -> Column helpers. All JVM-side built-ins, no Python UDF."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .patterns import MONTH_NUMBERS


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# --- categories ------------------------------------------------------------

def parent_category(detail) -> Column:
    """Text after the last '_'; 'OTHER' when there is none; null stays null."""
    d = _c(detail)
    return (F.when(d.isNull(), F.lit(None).cast("string"))
            .when(F.instr(d, "_") > 0, F.substring_index(d, "_", -1))
            .otherwise(F.lit("OTHER")))


def subcategory(detail) -> Column:
    """Text before the last '_'; the whole text when there is none."""
    d = _c(detail)
    tail = F.substring_index(d, "_", -1)
    return (F.when(F.instr(d, "_") > 0,
                   d.substr(F.lit(1), F.length(d) - F.length(tail) - F.lit(1)))
            .otherwise(d))


# --- money -----------------------------------------------------------------

def cents(x) -> Column:
    """Round to 2 places the way Python's round(float, 2) does.

    ``format_number`` with a plain pattern rounds the exact binary value
    half-to-even, which is what Python does; ``round``/``bround`` do not.
    """
    return F.call_function("format_number", _c(x).cast("double"), F.lit("0.00")).cast("double")


def currency(x) -> Column:
    """'$1,234.50' / '-$1,234.50' (two decimals, thousands separators)."""
    v = _c(x)
    body = F.format_number(F.abs(v), 2)
    return F.when(v < 0, F.concat(F.lit("-$"), body)).otherwise(F.concat(F.lit("$"), body))


def currency_abs(x) -> Column:
    return F.concat(F.lit("$"), F.format_number(F.abs(_c(x)), 2))


def money_out(x) -> Column:
    """Exact decimal money -> double for output."""
    return _c(x).cast("double")


# --- hashing / tokens ------------------------------------------------------

def sha_prefix(x, n: int) -> Column:
    return F.substring(F.sha2(_c(x), 256), 1, n)


def hash_user_id(x) -> Column:
    return sha_prefix(x, 12)


def hash_prompt(x) -> Column:
    return sha_prefix(x, 16)


def estimate_tokens(text) -> Column:
    """max(1, len // 4) with len in code points."""
    return F.greatest(F.lit(1), F.floor(F.length(_c(text)) / 4)).cast("bigint")


# --- number text -------------------------------------------------------------

def py_float_text(x) -> Column:
    """Python ``repr(float)``.

    Both languages print the shortest digits that read back (a JDK before 19
    may print one more of a 17-digit number). Java switches to
    exponents from 1e7 on and below 1e-3, Python from 1e16 on and below 1e-4,
    with a signed exponent of two digits at least; integral values keep '.0'
    unless an exponent follows.
    """
    v = _c(x).cast("double")
    s = v.cast("string")
    small, large = F.abs(v) < F.lit(1e-4), F.abs(v) >= F.lit(1e16)
    plain = F.regexp_replace(F.regexp_replace(
        F.when(F.abs(v) < 1, s.cast("decimal(38,24)").cast("string"))
        .otherwise(s.cast("decimal(38,10)").cast("string")), r"0+$", ""), r"\.$", ".0")
    sci = F.regexp_replace(s, r"\.0E", "E")
    sci = F.regexp_replace(F.regexp_replace(sci, r"E-(\d)$", "E-0$1"), r"E(\d)", "E+$1")
    sci = F.lower(sci)
    return (F.when(F.isnan(v), F.lit("nan"))
            .when(v == float("inf"), F.lit("inf")).when(v == float("-inf"), F.lit("-inf"))
            .when((v != 0) & (small | large), sci)
            .when(F.instr(s, "E") > 0, plain)
            .otherwise(s))


# --- dates -------------------------------------------------------------------

def month_label(d) -> Column:
    """'%b %Y' e.g. 'Mar 2025'."""
    return F.date_format(_c(d), "MMM yyyy")


def month_key(d) -> Column:
    """'%Y_%m' e.g. '2025_03'."""
    return F.date_format(_c(d), "yyyy_MM")


def month_number(name) -> Column:
    """Lower-case month name or 3-letter abbreviation -> 1..12."""
    m = F.create_map(*[x for k, v in MONTH_NUMBERS.items() for x in (F.lit(k), F.lit(v))])
    return F.element_at(m, _c(name))


def contains_any(text, words: list[str]) -> Column:
    """Substring test against a word list (the screening rules are substring
    based). A flat OR of ``contains`` stays inside whole-stage codegen and
    evaluates ``text`` once; a lambda over an array of words would not."""
    t = _c(text)
    out = None
    for w in words:
        hit = t.contains(w)
        out = hit if out is None else (out | hit)
    return out if out is not None else F.lit(False)
