"""Road-graph analytics as Spark DataFrame operators."""
