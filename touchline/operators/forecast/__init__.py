"""Forecasters. Each returns a prediction frame long by model."""
