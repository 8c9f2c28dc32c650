"""Assembled plans: the registered queries."""
