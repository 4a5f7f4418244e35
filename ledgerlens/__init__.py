"""ledgerlens: transaction-ledger analytics and text screening on Spark.

Every operator takes and returns a DataFrame covering *all* owners (users)
and requests at once; nothing is computed per user in a driver loop.
"""

__version__ = "0.1.0"
