"""Sievelight operators."""
