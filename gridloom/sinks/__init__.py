"""Sinks of gridloom."""
