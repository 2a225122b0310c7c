"""quantframe: a PySpark-native analytics engine for panel and time-series research."""
