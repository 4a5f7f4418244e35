"""One stored pass over the ledger for the answers and the numbers they are checked against."""

import random

import pytest

from ledgerlens import columns as C
from ledgerlens.operators import grounding as GR
from ledgerlens.operators import profile as PR
from ledgerlens.plans import screening_queries as S
from ledgerlens.sources import derived as D
from ledgerlens.sources import ledger as L

#: Tables with keys that are null, repeat or lead nowhere.
CUSTOMERS = [(i, f"Customer {i}") for i in range(1, 13)] + [(3, "Customer 3"), (4, "Another 4"), (None, "x")]
SUPPLIERS = [(i, f"Supplier {i % 4}") for i in range(1, 9)] + [(2, "Supplier 2"), (3, "Supplier b"), (5, None), (None, "x")]
PARTS = [(i, "STEEL", f"Brand#{i % 3}") for i in range(1, 7)] + [(2, "TIN", "Brand#9"), (3, None, "Brand#1"), (None, "x", "y")]


def _tables(spark, folder):
    rnd = random.Random(3)
    orders = [(i, rnd.choice([*range(1, 15), 1, 1, 1, None]), f"{rnd.randrange(2020, 2022)}-{rnd.randrange(1, 13):02d}-07 10:00:00")
              for i in range(150)] + [(7, 2, "2021-03-01 00:00:00"), (None, 1, "2021-03-01 00:00:00")]
    lines = [(rnd.choice([*range(152), None]), rnd.choice([*range(1, 8), None]), rnd.choice([*range(1, 11), None]),
              rnd.choice([None, 5.0, *[round(rnd.uniform(1, 900), 2) for _ in range(20)]]), rnd.choice("RNA"))
             for _ in range(700)]
    for name, rows, schema in (
            ("customer", CUSTOMERS, "c_custkey long, c_name string"),
            ("supplier", SUPPLIERS, "s_suppkey long, s_name string"),
            ("part", PARTS, "p_partkey long, p_type string, p_brand string"),
            ("orders", orders, "o_orderkey long, o_custkey long, o_orderdate string"),
            ("lineitem", lines, "l_orderkey long, l_partkey long, l_suppkey long, l_extendedprice double, l_returnflag string")):
        df = spark.createDataFrame(rows, schema)
        if name == "orders":
            df = df.withColumn("o_orderdate", df.o_orderdate.cast("timestamp_ntz"))
        df.write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def _two_passes(spark, d):
    a = D.answers(spark, d)
    flags = GR.number_flags(a, PR.actual_rows(L.driver_ledger(spark, d)), "answer_id")
    return a.join(flags, "answer_id", "left")


@pytest.mark.parametrize("hot", [L.HOT_ORDERS, 15, 0])
def test_one_stored_pass_gives_the_answers_and_flags_of_two(spark, tmp_path, monkeypatch, hot):
    """Also where owners are dealt out: none, some, all."""
    monkeypatch.setattr(L, "HOT_ORDERS", hot)
    d = _tables(spark, tmp_path)
    dealt = L.hot_owners(spark, d).count()
    assert {L.HOT_ORDERS: dealt == 0, 15: 0 < dealt < 10, 0: dealt >= 12}[hot]
    want = sorted(_two_passes(spark, d).collect(), key=str)
    got = sorted(S._answers(spark, d).select(_two_passes(spark, d).columns).collect(), key=str)
    assert got == want and len(got) == 12
    assert len({len(r.number_flags or []) for r in got}) > 1


def test_verified_numbers_of_the_stored_facts_are_those_of_the_ledger(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(L, "HOT_ORDERS", 15)
    d = _tables(spark, tmp_path)
    facts = S.owner_facts(spark, d)
    got = L.rows_of_owners(facts.where(f"{L.COPY} IS NOT NULL"),
                           lambda f, together: PR.actual_rows(facts=f, together=together))
    want = PR.actual_rows(L.driver_ledger(spark, d))
    assert got.exceptAll(want).count() == want.exceptAll(got).count() == 0 < got.count()


def test_the_flags_read_stored_facts(spark, tmp_path):
    d = _tables(spark, tmp_path)
    for query in (S.number_grounding, S.screen_answers):
        plan = query(spark, d)._jdf.queryExecution().optimizedPlan().toString()
        assert "l_extendedprice" not in plan and "s_name" not in plan


def test_owner_facts_shuffle_no_rows_after_they_lie_by_owner(spark, tmp_path):
    d = _tables(spark, tmp_path)
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = L.owner_ledger(spark, d, L.hot_owners(spark, d), 3)
        facts = PR.owner_facts(rows, names=False, together=True, apart=(L.COPY, L.DEALT))
        plan = facts._jdf.queryExecution().executedPlan().toString()
        assert plan.index("Generate inline") < plan.index("Exchange") and plan.count("Scan parquet") <= 6
        stored = S.owner_facts(spark, d)
        together = PR.actual_rows(facts=stored, together=True)._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in together and "Bucketed: true" in together
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)


def test_a_hot_owner_is_no_single_partition(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(L, "HOT_ORDERS", 15)
    d = _tables(spark, tmp_path)
    rows = L.owner_ledger(spark, d, L.hot_owners(spark, d), 4)
    parts = rows.where(f"{L.DEALT} = 1").rdd.mapPartitions(lambda it: [sum(1 for _ in it)]).collect()
    assert sum(x > 0 for x in parts) > 1
    one = rows.where(f"{L.DEALT} IS NULL AND {C.USER} = 9").rdd.mapPartitions(lambda it: [sum(1 for _ in it)]).collect()
    assert sum(x > 0 for x in one) == 1
