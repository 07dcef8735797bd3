"""Operators on tables: trees, evaluation, boxes, icons, actions."""
