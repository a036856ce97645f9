"""Readers, writers and the derived fixture views."""
