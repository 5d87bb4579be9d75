"""Column expressions shared by the operators; every one is a built-in composition."""
