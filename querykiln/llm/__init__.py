"""Operators for preparing training text: de-duplication, filters, formatting, mixing."""
