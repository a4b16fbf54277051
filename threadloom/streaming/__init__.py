"""Stores of sessions as streams."""
