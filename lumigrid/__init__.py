"""Spark-native analytics for imaging-spectroscopy scenes."""
