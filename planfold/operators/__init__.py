"""Operators from DataFrame to DataFrame over portfolio tables."""
