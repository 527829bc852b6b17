"""corpusloom: a Spark-native engine for document collections, embeddings and conversations."""

__version__ = "0.1.0"
