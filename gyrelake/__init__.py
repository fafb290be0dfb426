"""gyrelake: PySpark-native analytics for rotating-part inspection data."""
