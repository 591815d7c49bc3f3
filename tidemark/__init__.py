"""tidemark: ordered-series analytics as lazy Spark DataFrame operators.

Every public function takes and returns DataFrames (or Columns) and adds to the
logical plan; only fitted statistics (imputer medians, scaler moments, selected
feature lists, block widths) run a job, and those jobs return one small row.
"""

from tidemark.operators.series import SeriesSpec

__all__ = ["SeriesSpec"]
