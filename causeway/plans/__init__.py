"""Plans made of several operators: symbolic spaces, scenarios, the whole analysis."""
