"""quillspark: document retrieval and corpus analytics as Spark DataFrame plans."""
