"""quillspark: a Spark-first engine for computational text studies."""
