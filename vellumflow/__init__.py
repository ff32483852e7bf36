"""Spark-native document-intelligence engine: structured queries, text operators, pipelines and streams."""
