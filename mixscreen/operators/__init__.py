"""Operators on mixtures: DataFrame in, DataFrame out."""
