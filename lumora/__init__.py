"""Spark-native multimodal retrieval analytics."""
