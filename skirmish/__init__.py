"""Skirmish: team-game analytics as DataFrame-to-DataFrame functions on Spark."""
