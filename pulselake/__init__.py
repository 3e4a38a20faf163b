"""Spark-native analysis of long, multi-sensor biosignal recordings."""
