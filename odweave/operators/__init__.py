"""Relational and iterative operators over interaction, unit and anchor tables."""
