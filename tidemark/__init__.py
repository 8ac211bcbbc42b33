"""Tidemark: money-flow research tables as Spark DataFrame operators.

Every operator takes DataFrames and returns DataFrames.  Nothing here reads
rows back to the driver; the few eager calls (a stored intermediate, table
writers with their checks, exports) are named as such in their docstrings.
"""

__version__ = "0.1.0"
