"""Tables and their schemas."""
