"""Readers of foreign log, run and catalog files."""
