"""DataFrame -> DataFrame operators, all keyed by ``image_id``."""
