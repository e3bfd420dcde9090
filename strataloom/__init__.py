"""Cross-sectional panel building and stress-testing on Spark DataFrames."""

__version__ = "0.1.0"
