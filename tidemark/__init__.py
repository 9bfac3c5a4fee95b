"""Price-intelligence analytics expressed as Spark DataFrame plans."""
