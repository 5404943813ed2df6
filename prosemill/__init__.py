"""Prose lint analytics and training-data operators on Spark."""
