"""A document and training-data engine on PySpark."""
