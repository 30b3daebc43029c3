"""sedimill: a PySpark-native engine for curating text and media corpora."""

__version__ = "0.1.0"
