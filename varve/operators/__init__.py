"""Operators: each one maps DataFrames to DataFrames or fits a Spark ML stage."""
