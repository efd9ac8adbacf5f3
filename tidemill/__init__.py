"""Tidemill: price and volume bars, factors, dynamics and back-tests on Spark."""
