"""Requests, jobs and the service behind the command line."""
