"""Column functions: text, dates, geography, links, similarity."""
