"""Cleaning, matching and curating catalogue data with Spark."""
