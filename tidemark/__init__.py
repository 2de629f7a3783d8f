"""Versioned changelogs and corpus preparation on Spark."""
