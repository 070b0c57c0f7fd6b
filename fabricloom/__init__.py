"""fabricloom: Spark-first analytics for gridded and vector descriptions of built fabric."""
