"""DataFrame operators over passages, postings, vectors and rankings."""
