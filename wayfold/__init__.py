"""wayfold: a PySpark-native engine for content retrieval, recommendation and trip-plan data."""

__version__ = "0.1.0"
