"""Whole jobs: extraction, batch run, single documents."""
