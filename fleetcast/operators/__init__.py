"""DataFrame -> DataFrame operators keyed by ``asset_id``."""
