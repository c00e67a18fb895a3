"""Spark-native analytics over emission-factor data."""
