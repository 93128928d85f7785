"""Readers and writers: graph tables, snapshots, incident packs, registries."""
