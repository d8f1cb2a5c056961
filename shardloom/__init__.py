"""Spark-native preparation of image-text training data: DataFrame in, DataFrame out."""

__version__ = "0.1.0"
