"""folioscope: document-corpus analytics on Spark.

Every operator takes and returns DataFrames (or Columns); Spark does the partitioning,
shuffling and expression evaluation.
"""
