"""Tessera: Spark-native similarity, process analytics and validation."""
