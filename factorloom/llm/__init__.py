"""Operators that prepare training text: scans, tokens, archives, near duplicates, mixing, rules, sharding."""
