"""Readers of what an archive, a repository or a server's catalog holds."""
