"""Machine-condition analytics expressed as Spark DataFrame operators."""
