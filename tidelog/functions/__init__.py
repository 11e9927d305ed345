"""Column functions: times, attributes and page positions."""
