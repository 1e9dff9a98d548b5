"""A document-retrieval and text-processing engine on PySpark DataFrames."""
