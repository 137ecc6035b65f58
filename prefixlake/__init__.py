"""prefixlake: issuer-prefix intelligence as PySpark DataFrame transformations."""
