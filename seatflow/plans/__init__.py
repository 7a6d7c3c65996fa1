"""Composed jobs: table builds, serving queries, retrieval and demand model."""
