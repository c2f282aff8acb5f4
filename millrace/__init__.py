"""millrace: a PySpark-native analytics engine for text, vectors, evaluation statistics and event streams."""

__all__ = ["functions", "operators", "plans", "sources", "streaming"]
