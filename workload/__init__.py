"""Registered queries over the driver's tables, each next to its SQL counterpart."""
