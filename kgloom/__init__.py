"""Spark-native knowledge-graph analytics: a property graph, text cleaning, extraction, fusion and review as DataFrames."""
