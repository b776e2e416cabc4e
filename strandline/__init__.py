"""A Spark-native, SQL-first engine: versioned tables, live queries, topics, vectors."""
