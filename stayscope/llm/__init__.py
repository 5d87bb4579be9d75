"""Operators for preparing training text: formatting, filtering, joining, encoding, storing."""
