"""Readers and writers of vendor layouts."""
