"""Column functions: text rules and plane geometry."""
