"""Lectio sources."""
