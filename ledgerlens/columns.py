"""Column names of the ledger and of the request/response tables."""

USER = "user_id"
NAME = "user_name"
DATE = "transaction_date"
AMOUNT = "transaction_amount"
CATEGORY = "transaction_category_detail"
MERCHANT = "merchant_name"

LEDGER_COLUMNS = [USER, NAME, DATE, AMOUNT, CATEGORY, MERCHANT]

# derived
PARENT = "parent_category"
SUBCATEGORY = "subcategory"
DAY = "day"
MONTH = "month"

# money is exact decimal inside the engine; outputs are cast to double
MONEY_TYPE = "decimal(18,2)"
# loaded amounts keep what the source has; rounding happens at output
LOADED_MONEY_TYPE = "decimal(28,8)"
# time of a loaded row, where the source has one beside the day
TIME = "transaction_time"
