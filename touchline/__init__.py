"""Spark-native forecasting, evaluation and table-analysis operators."""
