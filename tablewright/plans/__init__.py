"""Declarative descriptions of what to compute, checked before any job starts."""
