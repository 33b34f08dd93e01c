"""Readers of nested and marked-up inputs."""
