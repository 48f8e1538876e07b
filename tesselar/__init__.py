"""tesselar: a PySpark-native engine for annotated matrices and benchmark evidence."""

__version__ = "0.1.0"
