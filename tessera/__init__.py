"""tessera: a PySpark-native engine for agent memory, request governance and corpus work."""

__version__ = "0.1.0"
