"""Operators for preparing training and evaluation text; nothing outside this package imports it."""
