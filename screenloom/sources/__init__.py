"""Readers and writers of captures, trees, targets and experiment files."""
