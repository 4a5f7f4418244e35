"""Request-log operators: history, few-shot context, chart state, cache
hits, failure runs (W2-W6), operation labels (X14), reports (R4, R5).

Ordered scans within a key (few-shot rows, failure runs) must not put one
key's rows into one task: a single service instance or user may hold a third
of the log. They run as a two-level scan over time buckets:

1. rows are windowed within (key, bucket) — a hot key is spread over its
   buckets;
2. a small per-(key, bucket) summary is scanned per key in bucket order
   (size = number of buckets, bounded by the time span, not by rows);
3. the bucket carry is joined back on (key, bucket).

Everything else is a partial aggregate (min/max_by) or a WindowGroupLimit
top-k, both of which combine map-side before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..functions import patterns as P

#: Results do not depend on the bucket. Rows of one (key, bucket) are sorted in
#: one task, so a busy log wants a fine one; a key has one summary row a bucket.
DEFAULT_BUCKET = "minute"


def infer_operation(prompt, n_charts) -> Column:
    """Charts first, then four keyword groups, then the default."""
    low = F.lower(F.col(prompt) if isinstance(prompt, str) else prompt)
    n = F.col(n_charts) if isinstance(n_charts, str) else n_charts
    out = F.when(n > 0, F.lit(P.OPERATION_WITH_CHARTS))
    for words, op in P.OPERATION_RULES:
        out = out.when(X.contains_any(low, words), F.lit(op))
    return out.otherwise(F.lit(P.OPERATION_DEFAULT))


def latency_band(ms) -> Column:
    """<2000 green, <5000 orange, else red."""
    m = F.col(ms) if isinstance(ms, str) else ms
    return F.when(m < 2000, F.lit("green")).when(m < 5000, F.lit("orange")).otherwise(F.lit("red"))


def recent_history(log: DataFrame, key: str = "user_id", ts: str = "ts",
                   tie: str = "request_id", keep: int = P.HISTORY_KEPT) -> DataFrame:
    """The last ``keep`` interactions per key (1 = newest).
    Plans as a WindowGroupLimit: each map task keeps at most ``keep`` rows
    per key before the shuffle, so a hot key costs nothing extra."""
    w = Window.partitionBy(key).orderBy(F.col(ts).desc(), F.col(tie).desc())
    return log.withColumn("position", F.row_number().over(w)).where(F.col("position") <= keep) \
        .withColumn("position", F.col("position").cast("bigint"))


def previous_rows(df: DataFrame, key: str, ts: str, tie: str, k: int, payload: list[str],
                  bucket: str = DEFAULT_BUCKET, out: str = "prev") -> DataFrame:
    """For every row, the ``k`` rows before it in (ts, tie) order within its
    key, oldest first, as array<struct<payload>> (skew-safe two-level scan)."""
    b = "_bucket"
    order = [F.col(ts), F.col(tie)]
    item = F.struct(*[F.col(c) for c in payload])
    rows = df.withColumn(b, F.date_trunc(bucket, F.col(ts)))
    # bucket tails: last k rows of every (key, bucket); partial top-k before the shuffle
    w_tail = Window.partitionBy(key, b).orderBy(F.col(ts).desc(), F.col(tie).desc())
    tails = (rows.withColumn("_r", F.row_number().over(w_tail)).where(F.col("_r") <= k)
             .select(key, b, ts, tie, item.alias("_item")))
    # carry into bucket: the k tail rows before the bucket's first tail row
    w_carry = Window.partitionBy(key).orderBy(F.col(b), *order).rowsBetween(-k, -1)
    w_first = Window.partitionBy(key, b).orderBy(*order)
    carry = (tails.withColumn("_carry", F.collect_list("_item").over(w_carry))
             .withColumn("_r", F.row_number().over(w_first))
             .where(F.col("_r") == 1).select(key, b, "_carry"))
    w_local = Window.partitionBy(key, b).orderBy(*order).rowsBetween(-k, -1)
    local = rows.withColumn("_local", F.collect_list(item).over(w_local))
    joined = local.join(carry, [key, b], "left")
    allprev = F.concat(F.coalesce(F.col("_carry"), F.array()), F.col("_local"))
    n = F.size(allprev)
    last_k = F.when(n > k, F.slice(allprev, n - k + 1, k)).otherwise(allprev)
    return joined.withColumn(out, last_k).drop(b, "_local", "_carry")


FEW_SHOT_HEADER = "PREVIOUS INTERACTIONS WITH THIS USER (for context continuity):\n"


def few_shot(log: DataFrame, key: str = "user_id", ts: str = "ts", tie: str = "request_id",
             bucket: str = DEFAULT_BUCKET) -> DataFrame:
    """The previous 3 interactions as the numbered few-shot block (null
    when there is none)."""
    prev = previous_rows(log, key, ts, tie, P.HISTORY_USED,
                         ["prompt", "operation", "result_summary"], bucket)
    lines = F.transform(F.col("prev"), lambda x, i: F.concat(
        F.lit("\n"), (i + 1).cast("string"), F.lit('. User asked: "'), x["prompt"],
        F.lit('"\n   Analysis performed: '), x["operation"],
        F.lit("\n   Key finding: "), x["result_summary"], F.lit("\n")))
    return prev.withColumn("few_shot", F.when(F.size("prev") > 0, F.concat(
        F.lit(FEW_SHOT_HEADER), F.array_join(lines, ""))))


def viz_state(charts: DataFrame, key: str = "user_id") -> DataFrame:
    """Latest successful chart per key (max_by = partial aggregate): its
    axes and filters, both the call's raw arguments (VARIANT), and the routed
    parameters (defaults filled)."""
    order = F.struct("ts", "request_id", "call_pos")
    params = ["months", "period", "top_n", "category_filter", "show_net_line"]
    latest = F.max_by(F.struct("chart_type", "ts", "raw_arguments", *params), order)
    return (charts.where(F.col("success")).groupBy(key).agg(latest.alias("_s"))
            .select(key, F.col("_s.chart_type").alias("last_chart_type"),
                    F.col("_s.raw_arguments").alias("axes"), F.col("_s.raw_arguments").alias("filters"),
                    *[F.col(f"_s.{p}").alias(p) for p in params],
                    F.col("_s.ts").alias("updated_at")))


def cache_hits(answered: DataFrame, key: str = "user_id", ts: str = "ts",
               tie: str = "request_id") -> DataFrame:
    """A request hits the profile cache unless it is its key's first
    answered request. First = partial min aggregate, joined back."""
    first = answered.groupBy(key).agg(F.min(F.struct(ts, tie)).alias("_first"))
    return (answered.join(first, key)
            .withColumn("cache_hit", F.struct(ts, tie) > F.col("_first")).drop("_first"))


def failure_runs(calls: DataFrame, key: str = "instance_id", ts: str = "ts",
                 tie: str = "call_id", status: str = "status",
                 bucket: str = DEFAULT_BUCKET,
                 threshold: int = P.BREAKER_THRESHOLD,
                 cooldown_s: int = P.BREAKER_COOLDOWN_SECONDS) -> DataFrame:
    """Consecutive failed calls since the last success per key.

    ``fail_pos`` counts failures since the last 'ok' (skipped calls do not
    count); every ``threshold``-th one trips the breaker (the counter restarts
    after the cooldown, and nothing is attempted meanwhile); ``in_cooldown``
    marks calls within ``cooldown_s`` after the latest trip.
    """
    b = "_bucket"
    ok = (F.col(status) == "ok").cast("bigint")
    bad = (F.col(status) == "failed").cast("bigint")
    w_run = Window.partitionBy(key, b).orderBy(ts, tie).rowsBetween(Window.unboundedPreceding, 0)
    rows = (calls.withColumn(b, F.date_trunc(bucket, F.col(ts)))
            .withColumn("_ok_cum", F.sum(ok).over(w_run))
            .withColumn("_fail_cum", F.sum(bad).over(w_run))
            .withColumn("_fail_at_ok", F.max(F.when(ok == 1, F.col("_fail_cum"))).over(w_run)))
    # per-bucket summary and carry-in of trailing failures
    summ = rows.groupBy(key, b).agg(
        (F.max("_ok_cum") > 0).alias("_has_ok"),
        (F.max("_fail_cum") - F.coalesce(F.max("_fail_at_ok"), F.lit(0))).alias("_tail"))
    w_b = Window.partitionBy(key).orderBy(b)
    summ = summ.withColumn("_grp", F.sum(F.col("_has_ok").cast("bigint")).over(
        w_b.rowsBetween(Window.unboundedPreceding, 0)))
    summ = summ.withColumn("_cs", F.sum("_tail").over(
        Window.partitionBy(key, "_grp").orderBy(b).rowsBetween(Window.unboundedPreceding, 0)))
    summ = summ.withColumn("_carry", F.coalesce(F.lag("_cs").over(w_b), F.lit(0)))
    rows = rows.join(summ.select(key, b, "_carry"), [key, b])
    local = F.col("_fail_cum") - F.coalesce(F.col("_fail_at_ok"), F.lit(0))
    pos = F.when(F.col("_ok_cum") == 0, F.col("_carry") + local).otherwise(local)
    rows = (rows.withColumn("fail_pos", F.when(bad == 1, pos).cast("bigint"))
            .withColumn("tripped", (bad == 1) & (pos % threshold == 0)))
    # latest trip before each call: within the bucket, else carried over buckets
    w_prev = Window.partitionBy(key, b).orderBy(ts, tie).rowsBetween(Window.unboundedPreceding, -1)
    trips = rows.groupBy(key, b).agg(F.max(F.when(F.col("tripped"), F.col(ts))).alias("_bt"))
    trips = trips.withColumn("_carry_trip", F.max("_bt").over(
        Window.partitionBy(key).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)))
    rows = (rows.join(trips.select(key, b, "_carry_trip"), [key, b])
            .withColumn("_local_trip", F.max(F.when(F.col("tripped"), F.col(ts))).over(w_prev)))
    last_trip = F.coalesce(F.col("_local_trip"), F.col("_carry_trip"))
    in_cool = last_trip.isNotNull() & (
        F.col(ts) < last_trip + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(cooldown_s)))
    flags = F.array_compact(F.array(
        F.when(bad == 1, F.lit("LLM_UNAVAILABLE")),
        F.when(F.col("tripped"), F.lit("CIRCUIT_BREAKER_TRIPPED")),
        F.when(F.col(status) == "skipped", F.lit("CIRCUIT_BREAKER_OPEN"))))
    return (rows.withColumn("in_cooldown", in_cool)
            .withColumn("flags", flags)
            .drop(b, "_ok_cum", "_fail_cum", "_fail_at_ok", "_carry", "_carry_trip", "_local_trip"))


def flag_severity(flag) -> Column:
    """Flag -> struct(severity, label) by the text before ':';
    unknown flags -> ('info', flag)."""
    f = F.col(flag) if isinstance(flag, str) else flag
    k = F.split(f, ":").getItem(0)
    sev = F.create_map(*[x for n, (s, _) in P.FLAG_SEVERITY.items() for x in (F.lit(n), F.lit(s))])
    lab = F.create_map(*[x for n, (_, lb) in P.FLAG_SEVERITY.items() for x in (F.lit(n), F.lit(lb))])
    return F.struct(F.coalesce(F.element_at(sev, k), F.lit("info")).alias("severity"),
                    F.coalesce(F.element_at(lab, k), f).alias("label"))


def flag_report(df: DataFrame, key: str, flags_col: str) -> DataFrame:
    """One row per flag with severity, label and the 'BLOCKED' marker."""
    e = df.select(key, F.posexplode(flags_col).alias("flag_pos", "flag"))
    s = flag_severity("flag")
    return e.select(key, F.col("flag_pos").cast("bigint"), "flag",
                    s["severity"].alias("severity"), s["label"].alias("label"),
                    F.when(s["severity"] == "error", F.concat(F.lit("BLOCKED: "), s["label"]))
                    .otherwise(s["label"]).alias("display"))


SPAN = 64


def running_sum(df: DataFrame, key: str, order: str, value, out: str, newest_first: bool = False,
                span: int = SPAN) -> DataFrame:
    """Running sum of ``value`` within ``key`` along the whole number ``order``
    (or against it), this row included, as a two-level scan: rows are summed
    within spans of ``span`` places, a key's spans carry over, so a hot key is
    spread over its spans."""
    b = "_span"
    way = (lambda c: F.col(c).desc()) if newest_first else (lambda c: F.col(c).asc())
    rows = df.withColumn(b, F.floor(F.col(order) / span)).withColumn("_value", value)
    w = Window.partitionBy(key, b).orderBy(way(order)).rowsBetween(Window.unboundedPreceding, 0)
    w_span = Window.partitionBy(key).orderBy(way(b)).rowsBetween(Window.unboundedPreceding, -1)
    carry = (rows.groupBy(key, b).agg(F.sum("_value").alias("_sum"))
             .withColumn("_carry", F.coalesce(F.sum("_sum").over(w_span), F.lit(0))).select(key, b, "_carry"))
    return (rows.withColumn("_own", F.sum("_value").over(w)).join(carry, [key, b])
            .withColumn(out, F.col("_carry") + F.col("_own")).drop(b, "_value", "_own", "_carry"))


def budgeted_suffix(turns: DataFrame, budget: int, key: str = "conv_id", order: str = "turn",
                    text: str = "text") -> DataFrame:
    """M2 to M4 on long conversations: the newest turns whose tokens together
    stay within the budget. Adds tokens, suffix_tokens (from the newest turn back
    to this one) and kept."""
    rows = turns.withColumn("tokens", X.estimate_tokens(text))
    return running_sum(rows, key, order, F.col("tokens"), "suffix_tokens", newest_first=True) \
        .withColumn("kept", F.col("suffix_tokens") <= budget)


def visible_history(turns: DataFrame, reset, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """R6 with clear: ``visible`` rows come after the key's last reset row
    (``reset``: a condition), numbered from 1 in ``visible_position``; rows up
    to it are cleared. The last reset is a partial aggregate joined back."""
    last = turns.groupBy(key).agg(F.max(F.when(reset, F.col(order))).alias("_reset"))
    rows = turns.join(last, key).withColumn(
        "visible", F.col("_reset").isNull() | (F.col(order) > F.col("_reset")))
    seen = running_sum(rows, key, order, F.col("visible").cast("bigint"), "visible_position")
    return seen.withColumn("visible_position", F.when(F.col("visible"), F.col("visible_position"))).drop("_reset")
