"""Relational operators: quality rules, profiles, join quality, reshaping, schema drift, rejects."""
