"""Readers and the views that stand in for a store's tables."""
