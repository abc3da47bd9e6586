"""Sample-table analytics on Spark: cleaning, balancing, encoding, drift, scoring and
summaries of wide tables of numeric measurements with missing values.

Every operator takes and returns Spark DataFrames.  Rows are identified by an explicit id
column, never by position.
"""

__version__ = "0.1.0"
