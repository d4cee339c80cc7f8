"""Column expressions over message text."""
