"""homecast: housing-price series analytics expressed as Spark DataFrame plans.

The package turns listing pages and raw sale histories into a clean sold-home
fact table, enriches it with county/region lookups, builds monthly, quarterly
and yearly price series, fills calendar gaps, decomposes and models the series
per key in parallel and serves parameterised history and forecast views.
Everything is lazy: functions take and return DataFrames.
"""

__version__ = "0.1.0"
