"""Exports of findings: SARIF, JSON, text."""
