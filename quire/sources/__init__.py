"""Readers that produce the canonical relations."""
