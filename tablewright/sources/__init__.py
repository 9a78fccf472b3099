"""Readers, writers and the catalog of datasets."""
