"""Orrery: a PySpark-native engine for spatial-reasoning question data."""
