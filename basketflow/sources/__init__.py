"""Readers, writers and the adapters onto the canonical event model."""
