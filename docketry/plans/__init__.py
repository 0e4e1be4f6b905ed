"""Whole queries: the ladder, and every operator over the driver's tables."""
