import datetime as dt
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from ledgerlens.session import local_session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = local_session(cores=4, shuffle_partitions=4, app="ledgerlens-tests")
    yield s


def ledger_df(spark, rows):
    """rows: (user_id, user_name, 'YYYY-MM-DD', amount, category, merchant)."""
    from decimal import Decimal
    data = [(u, n, dt.date.fromisoformat(d), Decimal(str(a)).quantize(Decimal("0.01")), c, m)
            for u, n, d, a, c, m in rows]
    return spark.createDataFrame(
        data, "user_id string, user_name string, transaction_date date, "
              "transaction_amount decimal(18,2), transaction_category_detail string, "
              "merchant_name string")


# frame of the reference's cache tests (8 rows, 2 owners)
CACHE_ROWS = [
    ("usr_001", "Alice", "2025-01-01", 100, "RENT_HOUSING", "AvalonBay"),
    ("usr_001", "Alice", "2025-01-15", -5000, "SALARY_INCOME", "Employer"),
    ("usr_001", "Alice", "2025-02-01", 200, "GROCERIES_FOOD", "Trader Joe's"),
    ("usr_001", "Alice", "2025-02-15", 50, "COFFEE_FOOD", "Starbucks"),
    ("usr_001", "Alice", "2025-03-01", 1500, "RENT_HOUSING", "AvalonBay"),
    ("usr_001", "Alice", "2025-03-15", -5000, "SALARY_INCOME", "Employer"),
    ("usr_002", "Bob", "2025-01-10", 300, "GYM_HEALTH", "LA Fitness"),
    ("usr_002", "Bob", "2025-02-10", -4000, "SALARY_INCOME", "Employer"),
]

# frame of the reference's chart tests (12 rows, 1 owner)
CHART_ROWS = [
    ("usr_test", "Test User", "2025-01-05", 1500, "RENT_HOUSING", "AvalonBay"),
    ("usr_test", "Test User", "2025-01-15", -5000, "SALARY_INCOME", "Employer"),
    ("usr_test", "Test User", "2025-01-20", 100, "GROCERIES_FOOD", "Trader Joe's"),
    ("usr_test", "Test User", "2025-02-01", 200, "GROCERIES_FOOD", "Whole Foods"),
    ("usr_test", "Test User", "2025-02-15", 50, "COFFEE_FOOD", "Starbucks"),
    ("usr_test", "Test User", "2025-02-28", -5000, "SALARY_INCOME", "Employer"),
    ("usr_test", "Test User", "2025-03-01", 1500, "RENT_HOUSING", "AvalonBay"),
    ("usr_test", "Test User", "2025-03-10", 300, "GYM_HEALTH", "Equinox"),
    ("usr_test", "Test User", "2025-03-20", 75, "STREAMING_ENTERTAINMENT", "Netflix"),
    ("usr_test", "Test User", "2025-04-01", 1500, "RENT_HOUSING", "AvalonBay"),
    ("usr_test", "Test User", "2025-04-15", -5000, "SALARY_INCOME", "Employer"),
    ("usr_test", "Test User", "2025-04-20", 200, "GROCERIES_FOOD", "Safeway"),
]
