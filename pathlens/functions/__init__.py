"""Column functions; they add no stage of their own to a plan."""
