"""Features, labels, ranking models and metrics over interaction logs, as Spark DataFrame plans."""
