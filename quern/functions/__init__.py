"""Column expressions: text cleaning, citations, paths, numbers, vectors."""
