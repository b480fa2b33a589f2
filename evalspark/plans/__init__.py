"""Query plans: the evaluate flow, the per-operator query catalog, oracle SQL."""
