"""Column-level building blocks: text, paths, documents and score arithmetic."""
