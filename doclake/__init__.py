"""doclake: documentation corpora as Spark DataFrames."""

__version__ = "0.1.0"
