"""Column expressions shared by all reports."""
