"""Readers of feeds and writers of packages."""
