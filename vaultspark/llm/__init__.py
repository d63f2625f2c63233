"""Operators for preparing training text: cleaning, matching, scoring and tokenizing."""
