"""Column expressions: text, names, paths, hashes, rules and similarities.  All stay inside Catalyst."""
