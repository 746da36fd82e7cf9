"""Fitted, stateless steps on arriving files."""
