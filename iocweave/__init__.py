"""Threat-indicator analytics as plain DataFrame transformations."""
