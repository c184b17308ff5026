"""Spark-native panels of time series: alignment, factors, regimes and tail risk."""
