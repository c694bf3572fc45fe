"""Strategies that give one result by different plans, and their cross-check."""
