"""Incremental work: resume by unit under a stamp guard."""
