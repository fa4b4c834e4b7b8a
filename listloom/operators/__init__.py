"""Operators over page, product and log tables."""
