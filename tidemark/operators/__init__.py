"""Operators: DataFrame -> DataFrame, nothing collected."""
