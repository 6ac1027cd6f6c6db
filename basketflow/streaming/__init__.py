"""Keyed session state over event streams."""
