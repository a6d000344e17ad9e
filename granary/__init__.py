"""A Spark-first engine for building and evaluating retrieval pipelines over text corpora."""
