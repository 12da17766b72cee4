"""Document analytics on Spark: layout, structure, chunking, quality, retrieval and tabular operators."""
