"""Recordings as they come in."""
