"""Named queries over the driver tables, with their check queries."""
