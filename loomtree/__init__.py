"""Document analytics on Spark: formats, path queries, pipelines, schemas, diffs and patches as DataFrames."""
