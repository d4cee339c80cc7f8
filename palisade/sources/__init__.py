"""Readers, and the package's way to the executors."""
