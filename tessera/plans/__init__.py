"""Augmentation plans: which views an image gets, with what parameters."""
