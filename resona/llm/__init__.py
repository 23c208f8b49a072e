"""Training-data operators: building blocks for preparing very large text corpora on Spark."""
