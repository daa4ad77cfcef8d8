"""Operators of a training-data pipeline: one module for each; ``queries`` applies them to whole tables."""
