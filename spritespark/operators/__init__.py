"""DataFrame-to-DataFrame operators over pixel, cel, palette, tag, slice and tile tables."""
