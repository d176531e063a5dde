"""PySpark-native evidence retrieval: ingestion, chunking, inverted index, ranking, packing and verification."""
