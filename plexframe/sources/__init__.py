"""Sources: tables with declared column roles, git logs, synthetic graphs."""
