"""Where the model tables come from: git repositories, files, warehouses, and bound tables."""
