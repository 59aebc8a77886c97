"""Corvane: code- and document-retrieval analytics written as Spark DataFrame plans."""
