"""Operators over fact graphs."""
