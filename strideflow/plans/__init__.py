"""Composed plans: fixture, gold analysis, dashboard tables, phases, job."""
