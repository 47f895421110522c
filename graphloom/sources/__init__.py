"""Readers, writers and parsers of tool output."""
