"""factorlake: Spark DataFrame operators for financial panel data."""
