"""Operators that prepare training text for language models; nothing outside imports this package."""
