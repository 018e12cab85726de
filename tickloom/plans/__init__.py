"""tickloom plans."""
