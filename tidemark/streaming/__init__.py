"""Following logs that grow."""
