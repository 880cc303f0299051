"""Spark-native analytics for network traffic and security events."""
