"""varve: Spark-native abundance graphs, evidence retrieval and corpus preparation."""
