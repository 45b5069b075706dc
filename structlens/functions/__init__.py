"""Column builders: no UDFs, everything stays in generated code."""
