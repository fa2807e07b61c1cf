"""Operators of a training-data pipeline. Nothing else in this repository imports this package."""
