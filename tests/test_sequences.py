"""Request-log operators; bucketed scans checked against plain windows."""

import datetime as dt
import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerlens.operators import sequences as Q

T0 = dt.datetime(2024, 1, 1)


def _calls(spark, statuses, key="svc_0", step_s=30):
    rows = [(i, key, T0 + dt.timedelta(seconds=i * step_s), s) for i, s in enumerate(statuses)]
    return spark.createDataFrame(rows, "call_id long, instance_id string, ts timestamp_ntz, status string")


def test_breaker_three_failures_trip(spark):
    r = Q.failure_runs(_calls(spark, ["failed"] * 3), bucket="minute").orderBy("call_id").collect()
    assert [x.tripped for x in r] == [False, False, True]
    assert list(r[2].flags) == ["LLM_UNAVAILABLE", "CIRCUIT_BREAKER_TRIPPED"]


def test_breaker_success_resets(spark):
    r = Q.failure_runs(_calls(spark, ["failed", "failed", "ok", "failed"]), bucket="minute") \
        .orderBy("call_id").collect()
    assert not any(x.tripped for x in r)
    assert r[3].fail_pos == 1


def test_breaker_skipped_calls_do_not_count(spark):
    r = Q.failure_runs(_calls(spark, ["failed", "failed", "failed", "skipped", "failed",
                                      "failed", "failed"], step_s=10), bucket="minute") \
        .orderBy("call_id").collect()
    assert [x.fail_pos for x in r] == [1, 2, 3, None, 4, 5, 6]
    assert [x.tripped for x in r] == [False, False, True, False, False, False, True]
    assert r[3].in_cooldown and list(r[3].flags) == ["CIRCUIT_BREAKER_OPEN"]


def test_failure_runs_bucketed_equals_plain_window(spark):
    rnd = random.Random(7)
    rows = []
    for key in ("a", "b"):
        t = T0
        for i in range(400):
            t += dt.timedelta(seconds=rnd.choice([5, 20, 70, 400]))
            rows.append((len(rows), key, t, rnd.choice(["ok", "failed", "failed", "skipped"])))
    df = spark.createDataFrame(rows, "call_id long, instance_id string, ts timestamp_ntz, status string")
    got = {r.call_id: (r.fail_pos, r.tripped, r.in_cooldown)
           for r in Q.failure_runs(df, bucket="minute").collect()}
    # plain per-key window formulation (one task per key; fine for a test)
    w = Window.partitionBy("instance_id").orderBy("ts", "call_id").rowsBetween(Window.unboundedPreceding, 0)
    fc = F.sum((F.col("status") == "failed").cast("int")).over(w)
    p = (df.withColumn("fc", fc)
         .withColumn("pos", F.col("fc") - F.coalesce(F.max(F.when(F.col("status") == "ok", F.col("fc"))).over(w), F.lit(0)))
         .withColumn("trip", (F.col("status") == "failed") & (F.col("pos") % 3 == 0)))
    wp = Window.partitionBy("instance_id").orderBy("ts", "call_id").rowsBetween(Window.unboundedPreceding, -1)
    p = p.withColumn("lt", F.max(F.when(F.col("trip"), F.col("ts"))).over(wp))
    want = {r.call_id: (r.pos if r.status == "failed" else None, r.trip,
                        r.lt is not None and r.ts < r.lt + dt.timedelta(seconds=60))
            for r in p.collect()}
    assert got == want


def test_previous_rows_bucketed_equals_plain_window(spark):
    rnd = random.Random(3)
    rows, t = [], T0
    for i in range(300):
        t += dt.timedelta(seconds=rnd.choice([1, 30, 90, 3600]))
        rows.append((i, rnd.choice(["u1", "u2", "u3"]), t, f"p{i}"))
    df = spark.createDataFrame(rows, "request_id long, user_id string, ts timestamp_ntz, prompt string")
    got = {r.request_id: [x.prompt for x in r.prev]
           for r in Q.previous_rows(df, "user_id", "ts", "request_id", 3, ["prompt"], "minute").collect()}
    w = Window.partitionBy("user_id").orderBy("ts", "request_id").rowsBetween(-3, -1)
    want = {r.request_id: list(r.prev) for r in
            df.select("request_id", F.collect_list("prompt").over(w).alias("prev")).collect()}
    assert got == want


def test_recent_history_and_cache_hits(spark):
    rows = [(i, "u", T0 + dt.timedelta(minutes=i), f"p{i}") for i in range(8)]
    df = spark.createDataFrame(rows, "request_id long, user_id string, ts timestamp_ntz, prompt string")
    h = Q.recent_history(df).orderBy("position").collect()
    assert [r.prompt for r in h] == ["p7", "p6", "p5", "p4", "p3"]
    c = {r.request_id: r.cache_hit for r in Q.cache_hits(df).collect()}
    assert c[0] is False and all(c[i] for i in range(1, 8))


def test_infer_operation_order(spark):
    df = spark.createDataFrame([("Show my top categories", 0), ("monthly trend", 0),
                                ("am I saving", 0), ("how much in total", 0), ("hello", 0),
                                ("hello", 2)], "p string, n int")
    ops = [r.o for r in df.select(Q.infer_operation("p", "n").alias("o")).collect()]
    assert ops[0].startswith("df.groupby(parent_category)")
    assert ops[1].startswith("df.resample")
    assert ops[2].startswith("df.groupby(df['transaction_amount'] > 0)")
    assert ops[3] == "df['transaction_amount'].sum()"
    assert ops[4].startswith("df.query(")
    assert ops[5].endswith(".plot()")


def test_flag_severity_default(spark):
    df = spark.createDataFrame([(1, ["UNGROUNDED_NUMBER:850.0", "CONTEXT_TRUNCATED_FROM_7500_TOKENS",
                                     "PROMPT_INJECTION_DETECTED"])], "id int, flags array<string>")
    r = Q.flag_report(df, "id", "flags").orderBy("flag_pos").collect()
    assert [(x.severity, x.label) for x in r] == [
        ("warning", "Ungrounded Number"),
        ("info", "CONTEXT_TRUNCATED_FROM_7500_TOKENS"),
        ("error", "Prompt Injection Blocked")]
    assert r[2].display == "BLOCKED: Prompt Injection Blocked"


def test_running_sums_suffixes_and_clears_equal_a_plain_window(spark):
    """A hot conversation over many spans, gaps between turns, resets inside."""
    import random

    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from ledgerlens.operators import sequences as Q
    rng = random.Random(3)
    rows = [(1, 3 * t + 1, rng.choice(["user", "system", "assistant"]) if t % 50 == 0 else "user", "x" * rng.randint(0, 40))
            for t in range(700)] + [(2, 0, "system", "a"), (3, 0, "user", "b"), (3, 1, "assistant", "c" * 9)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = Q.budgeted_suffix(df, 500).collect()
    want = {}
    for c in {r[0] for r in rows}:
        total = 0
        for _, t, _, text in sorted((r for r in rows if r[0] == c), key=lambda r: -r[1]):
            total += max(1, len(text) // 4)
            want[c, t] = (total, total <= 500)
    assert {(r.conv_id, r.turn): (r.suffix_tokens, r.kept) for r in got} == want
    seen = {(r.conv_id, r.turn): (r.visible, r.visible_position) for r in
            Q.visible_history(df, F.col("role") == "system").collect()}
    for c in {r[0] for r in rows}:
        cleared = max([t for k, t, role, _ in rows if k == c and role == "system"], default=-1)
        n = 0
        for t in sorted(t for k, t, _, _ in rows if k == c):
            n += t > cleared
            assert seen[c, t] == (t > cleared, n if t > cleared else None)
    assert Q.running_sum(df.where("false"), "conv_id", "turn", F.lit(1), "s").count() == 0
    plain = df.withColumn("s", F.sum(F.lit(1)).over(Window.partitionBy("conv_id").orderBy("turn")))
    assert sorted(Q.running_sum(df, "conv_id", "turn", F.lit(1), "s").select("conv_id", "turn", "s").collect()) == \
        sorted(plain.select("conv_id", "turn", "s").collect())


def test_cache_state_goes_from_batch_to_batch(spark, tmp_path):
    from ledgerlens.operators import sequences as Q
    from ledgerlens.operators.cache_state import merge_batch
    rows = [(i, f"u{i % 7 if i < 60 else i % 11}", i) for i in range(100)]
    log = spark.createDataFrame(rows, "request_id long, user_id string, ts long")
    whole = {(r.request_id, r.cache_hit) for r in Q.cache_hits(log).collect()}
    folder = str(tmp_path / "state")
    got = set()
    for b, (lo, hi) in enumerate([(0, 3), (3, 60), (60, 60), (60, 100)]):          # an empty batch among them
        part = log.where(f"request_id >= {lo} AND request_id < {hi}")
        got |= {(r.request_id, r.cache_hit) for r in merge_batch(part, folder, b).collect()}
        again = {(r.request_id, r.cache_hit) for r in merge_batch(part, folder, b).collect()}   # a batch that runs twice
        assert again <= got
    assert got == whole
    assert spark.read.parquet(folder).count() == 11


def test_chart_state_keeps_the_raw_arguments(spark):
    import json

    from pyspark.sql import functions as F

    from ledgerlens.operators import llm_tables as L
    from ledgerlens.operators import sequences as Q
    calls = [("plot_category_breakdown", '{"top_n": 3, "note": {"a": [1, null]}}'),
             ("plot_category_breakdown", '{"top_n": "many"}'), ("plot_pie", "{}")]
    df = spark.createDataFrame([(1, "u", [(f"c{i}", n, a) for i, (n, a) in enumerate(calls)])],
                               "request_id long, user_id string, tool_calls array<struct<id:string,name:string,arguments:string>>")
    charts = L.route_tool_calls(df).withColumn("user_id", F.lit("u")).withColumn("ts", F.lit(5))
    r = Q.viz_state(charts).select("*", F.to_json("axes").alias("a"), F.to_json("filters").alias("f")).collect()[0]
    assert json.loads(r.a) == json.loads(r.f) == {"top_n": 3, "note": {"a": [1, None]}}
    assert (r.period, r.top_n) == ("last_3_months", 3)
