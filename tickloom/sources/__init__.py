"""tickloom sources."""
