"""Registered queries with their SQL, by area."""
