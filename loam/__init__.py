"""A PySpark-native engine for document retrieval: parsing, chunking, indexing, hybrid search, packing, evaluation and run control as DataFrame operators."""
