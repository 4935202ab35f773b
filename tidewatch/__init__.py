"""tidewatch: Spark-native beacon analytics and training-data operators."""
