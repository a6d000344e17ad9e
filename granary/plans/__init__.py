"""Operators composed to whole runs."""
