"""kelvinlake: a PySpark-native engine for hierarchical measurement documents."""

__version__ = "0.1.0"
