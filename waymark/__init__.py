"""Waymark: road-network analytics on PySpark."""
