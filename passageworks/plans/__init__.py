"""Whole jobs composed of operators: indexing and answering."""
