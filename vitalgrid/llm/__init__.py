"""Operators for preparing training text: mixing, scoring, filtering, counting, scanning, deduplicating."""
