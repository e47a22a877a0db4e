"""Measurement operators: DataFrame in, DataFrame out."""
