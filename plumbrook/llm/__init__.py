"""Operators for building text corpora; nothing outside this package imports it."""
