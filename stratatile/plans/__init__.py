"""Schemas, profiles, run configs and the conversion of an archive into layers."""
