"""What the corpus operators share: white space, and the tables between steps."""

from __future__ import annotations

from ..store import BROADCAST_ROWS, materialize, new_path, release, shared_dir, sized

__all__ = ["BROADCAST_ROWS", "WHITE_SPACE", "WHITE_SPACE_RUN", "materialize", "new_path", "release", "shared_dir", "sized"]

#: ASCII white space, the separator between words in every operator here.
WHITE_SPACE = " \t\n\x0b\x0c\r"
WHITE_SPACE_RUN = r"[\x20\x09-\x0D]+"
