"""Where keys come from: local development roots, tenant registries, and key services behind small protocols."""
