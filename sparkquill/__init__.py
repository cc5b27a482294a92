"""Retrieval analytics on Spark: documents, chunks, keyword and vector search, fusion and contexts as DataFrame plans."""
