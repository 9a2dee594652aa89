"""Spark-native analytics for irregular time series and the catalogues around them."""
