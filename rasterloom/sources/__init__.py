"""Readers and writers for the interchange formats."""
