"""Readers, writers and the declared schemas of the cohort inputs."""
