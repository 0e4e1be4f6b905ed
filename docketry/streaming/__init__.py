"""An extension: the keyed store kept up to date from a stream. The batch operators need none of it."""
