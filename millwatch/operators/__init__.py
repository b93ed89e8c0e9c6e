"""DataFrame -> DataFrame operators of the fleet analytics engine."""
