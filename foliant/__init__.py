"""Document-library jobs on Spark: sync, annotate, search, answer, graph, report."""
