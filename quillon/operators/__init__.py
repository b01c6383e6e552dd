"""Relational operators that need more than one DataFrame call."""
