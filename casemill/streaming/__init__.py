"""Casemill streaming."""
