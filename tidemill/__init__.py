"""tidemill: Spark-first operators for building and evaluating text corpora."""
