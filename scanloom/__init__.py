"""A PySpark-native engine for spatial captures and the analytics around them."""
