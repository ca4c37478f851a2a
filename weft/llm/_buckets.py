"""Tables written in buckets, so that what comes from elsewhere meets their rows where they are."""

from weft.session import bucketed

__all__ = ["bucketed"]
