"""Frame operators, by family; Frame inherits them all."""
