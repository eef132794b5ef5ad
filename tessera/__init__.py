"""Spark-native preparation and analysis of image collections, representations and training text."""
