"""Reading and writing recordings."""
