"""Small NumPy helpers used inside Arrow batches; Spark does the grouping, joins and shuffles."""
