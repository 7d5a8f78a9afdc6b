"""Readers of landed registry extracts and writers of their products."""
