"""Writers: landing, model tables and the sandbox."""
