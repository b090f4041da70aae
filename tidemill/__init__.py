"""tidemill: a dataset-agnostic analytics pipeline on PySpark DataFrames.

Land files, profile every column, find keys and relationships, stage, build marts, run data
checks, watch row-count drift and answer guarded read-only SQL. All work on rows runs in Spark.
"""

from tidemill.session import build_session, new_scratch, prepare, stage

__all__ = ["build_session", "new_scratch", "prepare", "stage"]
