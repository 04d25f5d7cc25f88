"""Collections of PDF files."""
