"""Intermediate tables in the shared folder."""

from jobloom.sources.scratch import discard, materialize, scratch_dir

__all__ = ["discard", "fresh", "materialize", "scratch_dir"]


def fresh(columns: list[str], name: str) -> str:
    """``name``, or a longer one if a table has a column of that name."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name
