"""Whole queries: operators composed over the driver tables."""
