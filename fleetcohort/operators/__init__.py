"""Reusable DataFrame operators shared by the jobs in ``plans``."""
