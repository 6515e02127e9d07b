"""millrace: a PySpark-native engine for captured web documents and their event trails."""

__version__ = "0.1.0"
