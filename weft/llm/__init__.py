"""Operators for preparing training text at scale; ``queries`` registers them."""
