"""Plans that run several operators."""
