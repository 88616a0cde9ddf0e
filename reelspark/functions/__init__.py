"""Part of the media-facts engine."""
