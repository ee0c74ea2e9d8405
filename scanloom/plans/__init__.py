"""Helpers on plans: lineage, names, size-checked broadcasts."""
