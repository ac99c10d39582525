"""Readers and writers: OSM PBF extracts and PMTiles archives."""
