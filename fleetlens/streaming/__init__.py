"""streaming of the fleet-health library."""
