"""Rollup tiers, their upkeep, and retention."""
