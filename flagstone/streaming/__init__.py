"""File streams of event tables."""
