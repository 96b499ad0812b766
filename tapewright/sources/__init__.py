"""Table readers and writers with declared schemas."""
