"""Training-data pipeline operators on Spark.

Nothing outside this package imports it.  ``queries`` holds one registered
query per operator and the DuckDB text that must give the same rows.
"""
