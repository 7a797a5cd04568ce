"""Column expressions over one event."""
