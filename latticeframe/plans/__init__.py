"""Shape metadata, cost formulas and the contraction planner: driver-side, never an action."""
