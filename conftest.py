"""Makes the repository's top importable in tests."""
