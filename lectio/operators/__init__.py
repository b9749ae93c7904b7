"""Lectio operators."""
