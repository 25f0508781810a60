"""Quire: document analytics on Spark."""
