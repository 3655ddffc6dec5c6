"""Plans that chain transitions: a versioned task store, worker loops, runs of steps, bulk items."""
