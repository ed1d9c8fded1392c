"""Where pages, seeds and saved indexes come from, and where indexes go."""
