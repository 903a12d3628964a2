"""Relational operators as DataFrame functions."""
