"""End-to-end plans built from sources and operators."""
