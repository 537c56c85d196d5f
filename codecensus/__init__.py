"""codecensus: source-code corpus analytics as Spark DataFrame operators.

Every operator is a function from DataFrames to a DataFrame, keyed by ``repo``
so one job covers a whole corpus of repositories. Operators use Spark's own
SQL functions, joins, windows and aggregations; none calls a Python UDF.
"""

__version__ = "0.1.0"
