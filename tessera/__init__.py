"""tessera: Spark-native operators for study corpora, retrieval, adaptive learning and training-data pipelines."""
