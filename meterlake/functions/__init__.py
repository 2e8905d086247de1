"""Column functions: time, commands, identity, costs, display."""
