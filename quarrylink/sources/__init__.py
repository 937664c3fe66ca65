"""Readers, writers and record views."""
