"""Spark-native labelling, review-routing and evaluation operators."""

from fieldsift.functions.rules import RuleSet

__all__ = ["RuleSet"]
__version__ = "0.1.0"
