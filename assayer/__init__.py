"""assayer: evidence retrieval and evaluation as set-oriented Spark DataFrame transforms."""
