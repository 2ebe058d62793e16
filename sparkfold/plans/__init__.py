"""Session defaults and plan helpers."""
