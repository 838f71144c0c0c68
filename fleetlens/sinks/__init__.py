"""sinks of the fleet-health library."""
