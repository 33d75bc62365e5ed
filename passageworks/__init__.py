"""Spark operators for building and querying ticket retrieval corpora."""
