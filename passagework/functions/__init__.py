"""Column functions: text, URLs, analysis, links."""
