"""gridcast: hourly load forecasting, alerting and load-shedding schedules on Spark.

Plain ``DataFrame -> DataFrame`` functions over Catalyst expressions,
keyed by ``series_id`` so that any number of series run in one job.
"""

__version__ = "0.1.0"
