"""Failure-log analytics for data pipelines, written as Spark DataFrame transformations."""

__version__ = "0.1.0"
