"""Column expressions. Nothing here triggers a job or runs Python per row."""
