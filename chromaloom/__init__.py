"""A Spark-native engine for proximity-ligation link data and the analytics around it."""
