"""A Spark-native engine for stores of byte spans and the arrays that they hold."""
