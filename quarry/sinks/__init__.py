"""Where results go: CSV and text reports."""
