"""Behavioural time-series features and rank statistics on Spark."""
