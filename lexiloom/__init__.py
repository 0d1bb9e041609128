"""Token-level text analytics expressed as Spark DataFrame plans."""
