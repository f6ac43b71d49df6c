"""Settings, from the environment or given."""

from __future__ import annotations

import os
import tempfile
from dataclasses import dataclass, fields

# The defaults that users of the service rely on.
BLOCK_ROWS = 65_536
PACK_ROWS = 1_024
POSTING_CHUNK = 128
SEARCH_LIMIT = 1_000
TCP_BATCH_LINES = 1_000
TCP_FLUSH_MS = 300
DATAGRAM_BYTES = 65_536

#: Bytes of a request's body that the service takes unless told otherwise.
BODY_BYTES = 64 << 20


@dataclass(frozen=True)
class Settings:
    """Sizes and limits. `Settings.from_env()` reads SIEVELOG_<NAME>; what does not parse keeps its default."""

    block_rows: int = BLOCK_ROWS
    pack_rows: int = PACK_ROWS
    search_limit: int = SEARCH_LIMIT
    tcp_batch_lines: int = TCP_BATCH_LINES
    tcp_flush_ms: int = TCP_FLUSH_MS

    def __post_init__(self):
        object.__setattr__(self, "block_rows", max(1, self.block_rows))
        if self.pack_rows < 1:
            raise ValueError("pack_rows must be at least 1")

    @classmethod
    def from_env(cls, env=os.environ) -> "Settings":
        given = {}
        for f in fields(cls):
            text = env.get(f"SIEVELOG_{f.name.upper()}", "")
            if text.isdecimal():
                given[f.name] = int(text)
        return cls(**given)

    def resolve_limit(self, limit: int | None) -> int | None:
        """The limit of a request: 0 means none, absent means the default. None: unlimited.

        A default of 0 is taken as it is, so it gives no rows (but the full total).
        """
        if limit is None:
            return self.search_limit
        if limit < 0:
            raise ValueError("limit must not be negative")
        return limit or None


def shared_dir(spark) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where it is unset, local runs get a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.partition("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="sievelog-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")
