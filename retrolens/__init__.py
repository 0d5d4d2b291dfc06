"""A Spark-native engine for what-if analysis of committed transaction logs."""
