"""Training-data operators: thirteen Spark jobs over documents, pages and embeddings."""
