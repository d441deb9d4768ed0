"""Spark-first acquisition, cleaning and organisation of serialised long-form text."""
