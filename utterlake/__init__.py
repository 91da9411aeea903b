"""Speech and text corpora on Spark."""
