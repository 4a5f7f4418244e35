"""Prompt and answer screening as column expressions (map-only stages).

Every rule is a JVM regex or substring test evaluated per row inside whole-
stage codegen; there is no shuffle and no Python worker. Patterns are the
portable forms from ``functions.patterns`` (Python ``re`` semantics, no
recursive backtracking), so whole 20,000-word texts are safe.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..functions import patterns as P

_SPACE = P.portable(r"\s")
STRIP_PATTERN = f"^{_SPACE}+|{_SPACE}+$"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def matches_any(text: Column, patterns: list[str]) -> Column:
    """Search for any pattern, as an OR of separate searches: Java scans a
    pattern that starts with a literal with a Boyer-Moore skip, which a single
    alternation never gets; the OR stops at the first hit."""
    out = None
    for p in patterns:
        hit = text.rlike(P.portable(p))
        out = hit if out is None else (out | hit)
    return out


def py_strip(text) -> Column:
    """Python ``str.strip()``: a character-set trim, no regex pass."""
    return F.trim(_c(text), F.lit(P.PY_WHITESPACE))


def py_lower_strip(text) -> Column:
    """Python ``text.lower().strip()`` (strip removes Unicode whitespace)."""
    return py_strip(F.lower(_c(text)))


# --- input rules ------------------------------------------------------------

def injection_hit(prompt) -> Column:
    return matches_any(py_lower_strip(prompt), P.INJECTION_PATTERNS)


def cross_user_hit(prompt, user_id) -> Column:
    low = F.lower(_c(prompt))
    own = F.lower(_c(user_id))
    ids = F.regexp_extract_all(low, F.lit(P.USER_ID_PATTERN), F.lit(0))
    other_id = F.exists(ids, lambda x: x != own)
    return other_id | matches_any(low, P.CROSS_USER_PATTERNS)


def off_topic_hit(prompt) -> Column:
    low = py_lower_strip(prompt)
    return matches_any(low, P.OFF_TOPIC_PATTERNS) & ~X.contains_any(low, P.FINANCIAL_KEYWORDS)


def too_long(prompt) -> Column:
    return F.length(_c(prompt)) > P.MAX_PROMPT_LENGTH


def screen_prompts(df: DataFrame, prompt_col: str = "prompt",
                   user_col: str = "user_id") -> DataFrame:
    """Injection -> cross-user -> scope -> length; first failure wins.

    Adds booleans per rule, ``input_passed``, ``input_flag`` (null when
    clean), ``input_message`` and ``effective_prompt`` (the 500-character cut
    applies only to prompts that pass; regexes see the whole prompt). The
    lowered texts are computed once as their own columns.
    """
    inj, cross, scope, long_ = "is_injection", "is_cross_user", "is_off_topic", "is_too_long"
    base = (df.withColumn("_low", F.lower(F.col(prompt_col)))
              .withColumn("_low_strip", py_strip(F.col("_low"))))
    ls, lo = F.col("_low_strip"), F.col("_low")
    own = F.lower(F.col(user_col))
    ids = F.regexp_extract_all(lo, F.lit(P.USER_ID_PATTERN), F.lit(0))
    out = (base.withColumn(inj, matches_any(ls, P.INJECTION_PATTERNS))
               .withColumn(cross, F.exists(ids, lambda x: x != own)
                           | matches_any(lo, P.CROSS_USER_PATTERNS))
               .withColumn(scope, matches_any(ls, P.OFF_TOPIC_PATTERNS)
                           & ~X.contains_any(ls, P.FINANCIAL_KEYWORDS))
               .withColumn(long_, too_long(prompt_col))
               .drop("_low", "_low_strip"))
    flag = (F.when(F.col(inj), F.lit("PROMPT_INJECTION_DETECTED"))
            .when(F.col(cross), F.lit("CROSS_USER_LEAKAGE_ATTEMPT"))
            .when(F.col(scope), F.lit("OFF_TOPIC"))
            .when(F.col(long_), F.lit("INPUT_TRUNCATED")))
    message = (F.when(F.col(inj), F.lit(P.INJECTION_MESSAGE))
               .when(F.col(cross), F.lit(P.CROSS_USER_MESSAGE))
               .when(F.col(scope), F.lit(P.OFF_TOPIC_MESSAGE))
               .when(F.col(long_), F.lit(P.TRUNCATED_MESSAGE)))
    passed = ~(F.col(inj) | F.col(cross) | F.col(scope))
    return (out.withColumn("input_passed", passed)
               .withColumn("input_flag", flag)
               .withColumn("input_message", message)
               .withColumn("effective_prompt",
                           F.when(passed & F.col(long_),
                                  F.substring(F.col(prompt_col), 1, P.MAX_PROMPT_LENGTH))
                           .otherwise(F.col(prompt_col))))


# --- output rules -------------------------------------------------------------

def extracted_numbers(text) -> Column:
    """Dollar amounts first, then plain numbers > 1 (both kept: Q18)."""
    t = _c(text)
    dollars = F.transform(F.regexp_extract_all(t, F.lit(P.DOLLAR_PORTABLE), F.lit(0)),
                          lambda s: F.translate(s, "$,", "").try_cast("double"))
    plains = F.transform(F.regexp_extract_all(t, F.lit(P.PLAIN_NUMBER_JAVA), F.lit(1)),
                         lambda s: F.regexp_replace(s, ",", "").try_cast("double"))
    return F.concat(F.filter(dollars, lambda n: n.isNotNull()),
                    F.filter(plains, lambda n: n > 1))


def ungrounded_date_flags(text, start, end) -> Column:
    """G7: 'Month YYYY' mentions outside [first day of start month, end]."""
    low = F.lower(_c(text))
    names = F.regexp_extract_all(low, F.lit(P.MONTH_YEAR_PORTABLE), F.lit(1))
    years = F.regexp_extract_all(low, F.lit(P.MONTH_YEAR_PORTABLE), F.lit(2))
    pairs = F.arrays_zip(names.alias("m"), years.alias("y"))
    lo, hi = F.trunc(_c(start), "MM"), _c(end)

    def outside(p):
        y = p["y"].cast("int")
        d = F.make_date(y, X.month_number(p["m"]), F.lit(1))
        return F.when(y >= 1, (d < lo) | (d > hi)).otherwise(F.lit(False))

    bad = F.filter(pairs, outside)
    return F.transform(bad, lambda p: F.concat(
        F.lit("UNGROUNDED_DATE:"), F.initcap(p["m"]), F.lit(" "), p["y"]))


def hallucination_flags(text, number_flags, start, end) -> Column:
    """['POTENTIAL_HALLUCINATION'] + first 3 details, or []. The flags of
    numbers come from ``grounding.number_flags`` (null: none)."""
    details = F.concat(F.coalesce(_c(number_flags), F.array().cast("array<string>")),
                       F.when(_c(start).isNotNull() & _c(end).isNotNull(),
                              ungrounded_date_flags(text, start, end))
                       .otherwise(F.array().cast("array<string>")))
    return F.when(F.size(details) > 0,
                  F.concat(F.array(F.lit("POTENTIAL_HALLUCINATION")), F.slice(details, 1, 3))) \
        .otherwise(F.array().cast("array<string>"))


def toxic_hit(text) -> Column:
    return X.contains_any(F.lower(_c(text)), P.TOXICITY_KEYWORDS)


def hedging_hit(text) -> Column:
    return X.contains_any(F.lower(_c(text)), P.HEDGING_PHRASES)


def screen_answers(df: DataFrame, text_col: str = "response", numbers_col: str = "number_flags",
                   start_col: str = "first_date", end_col: str = "last_date",
                   rows_col: str = "n_rows", skip_grounding_col: str | None = None) -> DataFrame:
    """G11 + G12: toxicity blocks and replaces; otherwise grounding flags
    (unless skipped, e.g. for fallback answers) then confidence flags; notes
    are joined by a space and appended to the answer."""
    text = F.col(text_col)
    toxic = toxic_hit(text)
    skip = F.col(skip_grounding_col) if skip_grounding_col else F.lit(False)
    hall = F.when(skip, F.array().cast("array<string>")).otherwise(
        hallucination_flags(text, numbers_col, start_col, end_col))
    hedge = hedging_hit(text)
    sparse = F.col(rows_col) < P.SPARSE_ROWS
    conf_flags = F.concat(F.when(hedge, F.array(F.lit("LOW_CONFIDENCE"))).otherwise(F.array()),
                          F.when(sparse, F.array(F.lit("SPARSE_DATA"))).otherwise(F.array()))
    conf_msg = F.concat(
        F.when(hedge, F.lit(P.HEDGING_NOTE)).otherwise(F.lit("")),
        F.when(sparse, F.concat(F.lit(" Note: This analysis is based on only "),
                                F.col(rows_col).cast("string"),
                                F.lit(" transaction(s), which may limit accuracy.")))
        .otherwise(F.lit("")))
    conf_msg = F.when(hedge | sparse, F.trim(conf_msg))
    hall_msg = F.when(F.size(hall) > 0, F.lit(P.HALLUCINATION_MESSAGE))
    message = F.when(toxic, F.lit(P.TOXIC_MESSAGE)).otherwise(
        F.nullif(F.concat_ws(" ", hall_msg, conf_msg), F.lit("")))
    flags = F.when(toxic, F.array(F.lit("TOXIC_CONTENT_DETECTED"))).otherwise(
        F.concat(hall, conf_flags))
    final = (F.when(toxic, F.lit(P.TOXIC_MESSAGE))
             .when(F.col("output_message").isNotNull(),
                   F.concat(text, F.lit("\n\n⚠️ "), F.col("output_message")))
             .otherwise(text))
    return (df.withColumn("output_passed", ~toxic)
              .withColumn("output_flags", flags)
              .withColumn("output_message", message)
              .withColumn("final_response", final))
