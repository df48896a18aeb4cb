"""Array operators on coordinate frames."""
