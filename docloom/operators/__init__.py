"""Relational operators over guidelines, versions, sections and jobs."""
