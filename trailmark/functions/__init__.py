"""Column functions: keys, versions, verdicts, text and number formats."""
