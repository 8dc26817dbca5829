"""How iterative plans are driven: tables that cut lineage, and the fix-point loop."""
