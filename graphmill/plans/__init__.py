"""Query plans over the driver tables and over projects."""
