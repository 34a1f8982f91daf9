"""sources of gridloom."""
