"""wardwatch."""
