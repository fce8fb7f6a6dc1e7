"""The thin control loop around the plans: budgets, step choice, prefix reuse, search. Small driver-side state."""
