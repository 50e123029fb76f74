"""Column expressions shared by batch operators and streaming jobs."""
