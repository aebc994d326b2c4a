"""Waymark plans."""
