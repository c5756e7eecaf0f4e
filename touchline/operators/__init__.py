"""Operators over matches."""
