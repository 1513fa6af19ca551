"""DataFrame operators: detection, corpus set operations, profiles, classification, finance, training."""
