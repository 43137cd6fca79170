"""End-to-end plans over several operators."""
