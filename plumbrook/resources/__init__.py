"""Texts that belong to the package."""
