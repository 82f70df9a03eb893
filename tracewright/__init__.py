"""tracewright: a Spark-native engine for code-graph analytics over C sources and tables."""
