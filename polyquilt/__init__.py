"""A Spark-native engine for enumerating, reducing, storing and analysing periodic tilings."""
