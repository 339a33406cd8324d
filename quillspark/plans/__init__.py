"""Registered queries and their bindings to the driver's tables."""
