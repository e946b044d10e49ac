"""Casemill sources."""
