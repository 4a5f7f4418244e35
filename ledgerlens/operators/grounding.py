"""Numbers of answers against an owner's verified numbers as a band join.

A number n of an answer is grounded if an actual a of the same owner has
|n - a| / max(|a|, 1) below 5 %. Both sides are rows. Values are cut into bands
so that two values that near lie in the same band or in neighbours: bands of
equal ratio from 1 up, of equal width below. A number asks its own band and the
two beside it, so the join is an equality on (owner, band) and each number meets
the few actuals of three bands instead of all of its owner's. No row holds an
owner's categories; a hot owner's answers are a join partition that adaptive
execution splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..functions import patterns as P
from . import screening as G

#: Width of a band: above -ln(1 - tolerance) = 0.0513, with room for rounding.
BAND = 0.06


def band(v: Column) -> Column:
    """Number of the band that holds a value (rises with it)."""
    return F.when(v >= 1, F.floor(F.ln(v) / BAND)).otherwise(-1 - F.floor((1 - v) / BAND)).cast("bigint")


def answer_numbers(answers: DataFrame, id_col: str, key: str, text_col: str) -> DataFrame:
    """(answer, owner, pos, n): the numbers of each answer in their order."""
    return answers.select(id_col, key, F.posexplode(G.extracted_numbers(text_col)).alias("pos", "n"))


def ungrounded_numbers(numbers: DataFrame, actuals: DataFrame, id_col: str, key: str) -> DataFrame:
    """The numbers that no actual (rows of owner, value) backs; ``numbers`` is
    read twice."""
    own = band(F.col("n"))
    asked = numbers.withColumn("band", F.explode(F.array(own - 1, own, own + 1)))
    facts = actuals.select(F.col(key).alias("_owner"), F.col("value").alias("_a"), band(F.col("value")).alias("_band"))
    near = F.abs(F.col("n") - F.col("_a")) / F.greatest(F.abs(F.col("_a")), F.lit(1.0)) < P.GROUNDING_TOLERANCE
    backed = asked.join(facts, (F.col(key) == F.col("_owner")) & (F.col("band") == F.col("_band")) & near,
                        "left_semi").select(id_col, "pos").distinct()
    return numbers.join(backed, [id_col, "pos"], "left_anti")


def number_flags(answers: DataFrame, actuals: DataFrame, id_col: str, key: str = "user_id",
                 text_col: str = "response") -> DataFrame:
    """(answer, number_flags): the flags of the numbers without an actual, in
    the text's order, for answers that have any."""
    bad = ungrounded_numbers(answer_numbers(answers, id_col, key, text_col), actuals, id_col, key)
    flag = F.concat(F.lit("UNGROUNDED_NUMBER:"), X.py_float_text(F.col("n")))
    return bad.groupBy(id_col).agg(F.sort_array(F.collect_list(F.struct("pos", flag.alias("flag")))).alias("_f")) \
        .select(id_col, F.transform("_f", lambda x: x["flag"]).alias("number_flags"))
