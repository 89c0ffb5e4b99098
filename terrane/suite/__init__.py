"""Registered queries over the driver tables; see terrane.registry."""
