"""Whole jobs: from an extract to an archive."""
