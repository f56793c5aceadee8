"""Formula text to Spark plans."""
