"""Column functions: text normalisers, ordered rules and geography."""
