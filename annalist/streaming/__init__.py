"""Windowed statistics over streams of operations and scores."""
