"""tickloom operators."""
