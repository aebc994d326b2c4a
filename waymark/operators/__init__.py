"""Waymark operators."""
