"""Declarative feature programs."""
