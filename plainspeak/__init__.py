"""Comment moderation analytics on Spark DataFrames, batch and streaming."""

__version__ = "0.1.0"
