"""Whole audits built from operators."""
