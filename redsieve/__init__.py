"""A PySpark-native engine that finds and pseudonymises sensitive data in text."""
