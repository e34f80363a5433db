"""Pipelines and queries made of operators."""
