"""operators of gridloom."""
