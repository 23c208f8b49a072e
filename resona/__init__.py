"""resona: Spark-native condition monitoring, technical-document retrieval and evaluation analytics."""
