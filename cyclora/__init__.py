"""Cyclora: ordered-feature analytics on Spark."""
