"""Waymark functions."""
