"""Operators for preparing training text, each usable on any id and text column."""
