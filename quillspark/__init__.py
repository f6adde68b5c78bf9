"""quillspark: Spark-native retrieval, evaluation-set and corpus analytics."""
