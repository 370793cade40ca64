"""shoal: batch vector search and its data preparation, written as Spark plans."""
