"""Program-graph analytics on Spark: confidence-aware reachability over relational facts."""
