"""Part of siltstone; see the README for the map of modules."""
