"""Operators of a training-text pipeline; nothing else in the library imports this subpackage."""
