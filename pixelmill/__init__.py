"""pixelmill: a Spark-native analytics engine for pixel, frame and strip tables."""
