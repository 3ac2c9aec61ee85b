"""Distributed statistics for tabular measurement data, on PySpark DataFrames.

Every public operator takes DataFrames and returns DataFrames (or a small model
object whose size depends on columns, groups or clusters, never on rows).
"""

__version__ = "0.1.0"
