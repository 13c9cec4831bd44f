"""Spark-native air-traffic scenario analytics."""
