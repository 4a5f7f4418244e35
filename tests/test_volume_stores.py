"""One pass over the ledger for what a session stores."""

from conftest import CACHE_ROWS, SF, ledger_df
from pyspark.sql import functions as F

from ledgerlens import columns as C
from ledgerlens.sources import derived as D
from ledgerlens.sources.ledger import driver_ledger


def test_answers_quote_the_ledger_without_merchants(spark, tmp_path):
    """A supplier row that comes twice doubles the verified numbers, not the answers."""
    import os
    for t in ("lineitem", "orders", "customer", "part"):
        os.symlink(f"{SF}/{t}.parquet", tmp_path / f"{t}.parquet")
    one = spark.read.parquet(f"{SF}/supplier.parquet")
    one.unionAll(one).write.parquet(str(tmp_path / "supplier.parquet"))
    got, want = (D.answers(spark, x).select("answer_id", "response", "n_rows") for x in (str(tmp_path), SF))
    assert got.exceptAll(want).count() == want.exceptAll(got).count() == 0 < got.count()
    twice = {r.user_id: r.n for r in driver_ledger(spark, str(tmp_path)).groupBy("user_id").agg(F.count("*").alias("n")).collect()}
    assert twice == {r.answer_id: 2 * r.n_rows for r in want.collect()}


def test_verified_numbers_shuffle_by_owner_once(spark):
    from ledgerlens.operators import profile as PR
    plan = PR.actual_rows(driver_ledger(spark, SF))._jdf.queryExecution().executedPlan().toString()
    assert sum("Exchange hashpartitioning" in x and "grain" in x for x in plan.splitlines()) == 2


def test_stored_facts_hold_what_cards_read(spark):
    from ledgerlens.plans.card_store import CardStore
    store = CardStore(spark, buckets=4)
    store.refresh(ledger_df(spark, CACHE_ROWS))
    assert store.facts().where("grain <> 'owner' AND (n_expense = 0 OR first_date IS NOT NULL)").count() == 0


def test_the_log_cuts_the_ledger_before_its_dimensions(spark):
    led = D.requested_ledger(spark, SF)
    lines = led._jdf.queryExecution().optimizedPlan().toString().splitlines()
    depth = {i: len(x) - len(x.lstrip(" :+-")) for i, x in enumerate(lines)}
    semi = [depth[i] for i, x in enumerate(lines) if "Join LeftSemi" in x]
    dims = [depth[i] for i, x in enumerate(lines) if "Join Inner" in x and ("p_partkey" in x or "s_suppkey" in x or "c_custkey" in x)]
    assert len(semi) == 1 and len(dims) == 3 and min(semi) > max(dims)
    want = driver_ledger(spark, SF).join(D.requests(spark, SF).select(C.USER).distinct(), C.USER, "left_semi")
    assert led.exceptAll(want.select(led.columns)).count() == want.select(led.columns).exceptAll(led).count() == 0 < led.count()


def test_log_tables_aggregate_the_cut_ledger(spark, monkeypatch):
    from ledgerlens.plans import log_queries as L
    given = []
    monkeypatch.setattr(L, "stored", lambda spark, name, inputs, build: build() if name == "screened" else spark.range(0))
    monkeypatch.setattr(L.PL, "screened", lambda requests, names: requests)
    monkeypatch.setattr(L.PL, "owner_tables", lambda *a: given.extend(a) or {"names": None})
    L.log_tables(spark, SF)
    assert len(given) == 1 and "LeftSemi" in given[0]._jdf.queryExecution().optimizedPlan().toString()
