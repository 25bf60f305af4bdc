"""glossa: Spark-native preparation, scoring and error analysis of text-pair datasets.

Every operator is a function ``DataFrame -> DataFrame`` built from Spark SQL
expressions; Python workers are used only where a sequential algorithm
(LCS dynamic programming, dense vector similarity) or a user function is
involved, and then through Arrow-batched pandas UDFs.
"""

__version__ = "0.1.0"
