"""Spark-native analytics engine: operators over DataFrames, declared for Catalyst."""
