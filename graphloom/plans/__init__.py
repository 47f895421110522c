"""Ordered change plans."""
