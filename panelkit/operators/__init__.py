"""Operators on tables: cleaning, panels, audits, sampling, text, evidence and statistics."""
