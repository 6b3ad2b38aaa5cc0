"""Relational operators that the analyzer composes plans of."""
