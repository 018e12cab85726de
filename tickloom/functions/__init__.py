"""tickloom functions."""
