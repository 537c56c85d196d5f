"""DataFrame -> DataFrame operators, grouped as in the blueprint (§2.2-§2.9)."""
