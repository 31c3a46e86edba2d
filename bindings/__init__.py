"""The analyses bound to the driver's tables, each beside the SQL that must agree with it."""
