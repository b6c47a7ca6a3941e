"""A PySpark-native analytics and machine-learning engine."""
