"""An extension: the weekly load as a stream."""
