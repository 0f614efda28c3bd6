"""Spark operators for box, label, sensor and vector tables."""
