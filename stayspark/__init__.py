"""stayspark: short-stay booking analytics as lazy Spark DataFrames."""

__version__ = "0.1.0"
