"""Casemill functions."""
