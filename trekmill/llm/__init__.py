"""Operators that prepare training text at scale; nothing outside this subpackage imports it."""
