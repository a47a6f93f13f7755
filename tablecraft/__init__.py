"""tablecraft: analytical-table maintenance as plain DataFrame functions on stock Spark."""

__version__ = "0.1.0"
