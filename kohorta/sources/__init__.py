"""Readers, writers and restartable stages."""
