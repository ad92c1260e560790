"""Document retrieval, question answering and their evaluation as Spark DataFrame plans."""
