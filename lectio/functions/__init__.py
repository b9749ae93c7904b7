"""Lectio functions."""
