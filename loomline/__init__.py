"""Loomline: DataFrame operators that turn agent event logs into training and evaluation data."""

__version__ = "0.1.0"
