"""Operators over keyed tables, one module per container type."""
