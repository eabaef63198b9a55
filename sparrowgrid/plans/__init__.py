"""Expression front end and contraction planner."""
