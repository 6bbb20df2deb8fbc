"""Derived views over the driver tables and the registered queries."""
