"""Registered queries and their SQL twins for a second engine."""
