"""docketspark: leakage-safe temporal features, ranking metrics and data audits on Spark."""
