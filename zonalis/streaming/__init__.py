"""Live view of a running tile acquisition."""
