"""Operators for preparing a text corpus as training data (ten numbered operators)."""
