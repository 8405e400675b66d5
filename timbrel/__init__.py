"""timbrel: a Spark-first engine for timed-transcript corpora."""
