"""Lumenfold: a PySpark-native analytics engine for vision annotation data and training corpora."""
