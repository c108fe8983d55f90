"""Spark-native analytics for image, cube, frame-stack, header and catalogue tables."""
