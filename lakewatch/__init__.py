"""Spark-native monitoring and analysis of large collections of published documents."""
