"""DataFrame operators: extraction, discovery, resolution, queue and monitoring."""
