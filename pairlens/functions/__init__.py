"""Column functions: text forms, fingerprints, versions, set measures, and kernels."""
