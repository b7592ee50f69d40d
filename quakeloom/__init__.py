"""quakeloom: earthquake-catalog processing on PySpark DataFrames."""

__version__ = "0.1.0"
