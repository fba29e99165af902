"""Operators for preparing language-model training text. Nothing else in tramline imports this package."""
