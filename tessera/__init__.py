"""Spark-native diagnostic analytics: DataFrame operators over traces, logs, graphs and documents."""
