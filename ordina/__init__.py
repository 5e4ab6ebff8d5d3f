"""Ordered-series and text analytics expressed as Spark DataFrame operators."""
