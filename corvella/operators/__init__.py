"""Operators over the chunk relation."""
