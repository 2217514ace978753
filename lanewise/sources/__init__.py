"""Readers and writers of the raw feeds, the observation table and stored artifacts."""
