"""Operators with ordered state."""
