"""Composite jobs, sinks and the command-line entry."""
