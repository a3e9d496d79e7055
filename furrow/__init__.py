"""furrow: Spark-native analytics over satellite time series kept as tables."""
