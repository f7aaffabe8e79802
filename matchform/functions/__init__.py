"""Column expressions: no DataFrame, no action, all inside code generation."""
