"""Readers, writers and table providers."""
