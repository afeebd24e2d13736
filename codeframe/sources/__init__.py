"""Reading and writing: source trees, index tables, git and tool output, vulnerability patterns, stores."""
