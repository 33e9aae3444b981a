"""Ensemble regression analytics as Spark DataFrame and Spark ML jobs."""
