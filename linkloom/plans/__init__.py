"""Relations and registered queries."""
