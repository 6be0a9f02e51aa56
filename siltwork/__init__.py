"""siltwork: incremental, declarative, per-key merging of records on Spark."""

__version__ = "0.1.0"
