"""Where registries, claims and models come from, and where they go."""
