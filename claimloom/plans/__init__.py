"""Composed jobs, and the registered queries that check every operator."""
