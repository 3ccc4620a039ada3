"""siftmark: Spark-first data and analytics engine for generative retrieval corpora."""
