"""Event scans, file and catalog sources, and the test-data binding."""
