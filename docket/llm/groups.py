"""Walking key groups; see docket.functions.groups."""

from docket.functions.groups import key_groups

__all__ = ["key_groups"]
