"""Analytics over large tables of two-sided contests, written for Spark."""
