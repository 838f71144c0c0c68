"""operators of the fleet-health library."""
