"""Column-level functions (text, time, money, JSON)."""
