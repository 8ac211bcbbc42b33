"""Market-shaped tables derived from the driver's tables, and the query catalog."""
