"""Graph operators: each takes node and edge DataFrames and returns one."""
