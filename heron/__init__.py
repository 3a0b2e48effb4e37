"""heron: web-corpus analytics expressed as Spark DataFrame plans."""
