"""The registered queries: operators on surrogate relations made from the driver's tables, with their SQL."""
