"""Document-corpus analytics as Spark DataFrame plans."""
