"""Sievelight sources."""
