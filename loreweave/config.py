"""All settings in one frozen object, read from the environment. Names of variables and defaults are fixed values of the interface."""

from __future__ import annotations

import os
from dataclasses import dataclass, field


def truthy(value: str | None, default: bool = False) -> bool:
    """1, true and yes are true, in any case; unset gives the default."""
    return default if value is None else value.strip().lower() in ("1", "true", "yes")


@dataclass(frozen=True)
class Config:
    content_folder: str = "./content/wikipedia"
    work_folder: str = "./work"
    batch_size: int = 256
    debug_pages: bool = False
    average_interval: int = 20
    ingest: bool = True
    process: bool = True
    store: bool = True
    skip_store: bool = False
    dimension: int = 512
    max_tokens: int = 4096
    overlap: int = 10
    progress_lines: int = 1_000_000
    seed: int = 0
    probes: int = 150
    lists: int = 3464
    spill: int = 2
    attempts: int = 3
    concurrent: bool = False
    token_budget: int = 65_536
    sources: tuple[str, ...] = field(default=("enwiki", "frwiki"))

    @classmethod
    def from_environment(cls, env: dict[str, str] | None = None) -> Config:
        e = os.environ if env is None else env
        base = cls()
        return cls(
            content_folder=e.get("WIKIPEDIA_CONTENT_FOLDER", base.content_folder),
            batch_size=int(e.get("WIKIPEDIA_PROCESS_BATCH_SIZE", base.batch_size)),
            debug_pages=truthy(e.get("DEBUG_EXTRACTION")),
            average_interval=int(e.get("PROCESSING_BATCH_AVERAGE_INTERVAL", base.average_interval)),
            ingest=truthy(e.get("SVC_KB_ENABLE_INGESTION"), True),
            process=truthy(e.get("SVC_KB_ENABLE_PROCESSING"), True),
            store=truthy(e.get("SVC_KB_ENABLE_STORING"), True),
            skip_store=truthy(e.get("DB_SKIP_STORE")),
            dimension=int(e.get("WIKIPEDIA_EMBEDDING_MAX_DIMENSION", base.dimension)),
            max_tokens=int(e.get("WIKIPEDIA_EMBEDDING_MODEL_MAX_LENGTH", base.max_tokens)),
            seed=int(e.get("WIKIPEDIA_RNG_SEED", base.seed)),
            concurrent=truthy(e.get("SVC_KB_CONCURRENT_STAGES")),
        )
