"""Code-intelligence analytics on Spark: relations in, relations out."""
