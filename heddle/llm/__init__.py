"""Operators for preparing training text at scale; nothing else in heddle imports this subpackage."""
