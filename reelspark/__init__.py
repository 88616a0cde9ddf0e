"""Media-facts analytics over many files at once, as Spark DataFrame operators."""
