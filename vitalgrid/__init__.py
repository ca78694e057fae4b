"""vitalgrid — per-entity time-series ("panel") analytics on Spark DataFrames.

Every operator is a function ``DataFrame -> DataFrame`` built from Spark SQL
expressions; actions happen only in gates, fits and sinks.
"""

from vitalgrid.session import build_session, checkpoint_dir

__all__ = ["build_session", "checkpoint_dir"]
