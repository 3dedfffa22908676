"""Rendering and publishing tables."""
