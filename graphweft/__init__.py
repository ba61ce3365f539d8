"""graphweft: labelled property-graph queries planned as Spark DataFrames."""

__version__ = "0.1.0"
