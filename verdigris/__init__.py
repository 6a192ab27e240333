"""verdigris: a Spark-native engine for typed decision datasets."""
