"""A PySpark-native analytics engine for agent-trajectory datasets."""

__version__ = "0.1.0"
