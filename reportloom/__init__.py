"""reportloom: a PySpark-native engine for evaluating generated, semi-structured text at scale."""

__version__ = "0.1.0"
