"""Readers that turn files into rows and markdown."""
