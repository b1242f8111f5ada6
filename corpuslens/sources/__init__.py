"""Scans of repositories, logs and notes, and what is written back."""
