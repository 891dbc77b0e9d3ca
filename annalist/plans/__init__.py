"""Registered queries with their SQL, and the scenario that they run on."""
