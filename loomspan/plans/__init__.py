"""SQL front end and the registered query suites."""
