"""Compilation of rule sets to plans, and what is reported of them."""
