"""Encoders of machine-readable codes."""
