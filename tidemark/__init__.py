"""Daily price panels and text corpora on Spark."""
