"""End-to-end chains built from the operators: survey tables, designs, areas, trends."""
