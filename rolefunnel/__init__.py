"""rolefunnel: collect, clean, de-duplicate, classify, score and store posting records on Spark.

Every operator takes and returns DataFrames (or Columns) and leaves the
physical plan to Catalyst.  Rules, weights, thresholds and the evaluation time
are always arguments.
"""
