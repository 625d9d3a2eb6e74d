"""arbolith: hierarchies, names and records as Spark DataFrames."""

__version__ = "0.1.0"
