"""Relational and statistical operators over sessions."""
