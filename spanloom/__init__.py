"""spanloom: document analytics, span detection and privacy protection on Spark DataFrames."""

__version__ = "0.1.0"
