"""Streams: an extension, since the reference works on finished tables only."""
