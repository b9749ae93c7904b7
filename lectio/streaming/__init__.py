"""Lectio streaming."""
