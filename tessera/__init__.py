"""Spark-native interval, contact-map and training-data operators."""
