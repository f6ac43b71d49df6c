"""Boolean full-text search over log lines, as Spark plans."""
