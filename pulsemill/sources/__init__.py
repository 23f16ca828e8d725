"""Readers of device files and writers of results."""
