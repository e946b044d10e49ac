"""Casemill operators."""
