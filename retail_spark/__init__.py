"""retail_spark — Spark-native retail / point-of-sale analytics.

Sub-packages:

* ``sources``   — readers, writers and the canonical views over the input tables
* ``functions`` — column expressions (calendar, tiers, rules, text)
* ``operators`` — reusable relational building blocks (filters, joins,
  aggregates, windows, ordered/global ranking, set operations)
* ``plans``     — the domain analyses built from those blocks (reporting,
  customer features and segments, demand time series, recommendation,
  anomaly scoring, inventory) and model fitting on MLlib
* ``streaming`` — Structured Streaming versions of the ledger and daily sales
"""

__version__ = "0.1.0"
