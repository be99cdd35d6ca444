"""Ratings analytics and recommendation as plain Spark DataFrame functions."""
