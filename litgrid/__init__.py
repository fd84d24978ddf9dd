"""Literature analytics expressed as Spark DataFrame operators."""
