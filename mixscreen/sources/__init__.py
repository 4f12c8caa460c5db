"""Fixed tables, and files."""
