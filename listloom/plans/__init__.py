"""Whole flows made of operators: shop rules, products, listings."""
