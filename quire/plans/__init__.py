"""Whole flows: the translation plan, jobs, the command line."""
