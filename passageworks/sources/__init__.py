"""Readers, writers, table management and question sources."""
