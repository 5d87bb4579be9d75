"""Short-term-rental market analytics expressed as Spark DataFrame operators."""
