"""The daily run over newly landed files only."""
