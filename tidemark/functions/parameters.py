"""Parameters of work as JSON text of any depth: what a reader may not see, and one text for equal parameters."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Keys that hold locations, fields that hold secrets, and what stands in their place.
PATH_KEYS = [
    "baseDir", "base_dir", "path", "repo_path", "wal_path", "wal_archive_dir", "repoPath", "walPath", "server_path", "serverPath", "source", "mountpoint", "remoteHost", "hosts", "repo", "wal",
    "source_repo", "source_wal", "destination", "dead_branch_dir", "fix_commands", "current",
]
SECRETS = [("offsite", "access_key"), ("offsite", "secret_key"), ("into", "password")]
HIDDEN, REDACTED = "(hidden)", "•••"
_LOCATION = re.compile(r"[/:\\]")


def _without_paths(value, key: str | None = None):
    named = key in PATH_KEYS
    if isinstance(value, str):
        # A source may also be a plain word.
        return HIDDEN if named and (key != "source" or _LOCATION.search(value)) else value
    if isinstance(value, list):
        return [HIDDEN if named and isinstance(x, str) else _without_paths(x) for x in value]
    if isinstance(value, dict):
        return {k: _without_paths(x, k) for k, x in value.items()}
    return value


def _without_secrets(value):
    if isinstance(value, dict):
        for part, field in SECRETS:
            held = value.get(part)
            if isinstance(held, dict) and isinstance(held.get(field), str) and held[field]:
                value = value | {part: held | {field: REDACTED}}
    return value


def _rewritten(document: Column, change: Callable, ordered: bool = False) -> Column:
    def one(text: str | None) -> str | None:
        try:
            return None if text is None else json.dumps(change(json.loads(text)), ensure_ascii=False, separators=(",", ":"), sort_keys=ordered)
        except ValueError:
            return None

    def rewrite(texts: pd.Series) -> pd.Series:
        return pd.Series([one(x) for x in texts], dtype=object)

    return F.pandas_udf(rewrite, StringType())(document)


def shown(document: Column) -> Column:
    """Parameters as one without rights may see them (F8): locations hidden by key at any depth, secrets replaced. What is no JSON is null."""
    return _rewritten(document, lambda x: _without_paths(_without_secrets(x)))


def stable(document: Column) -> Column:
    """The same text for equal parameters: keys in order at every depth, no blanks; lists keep their order. What is no JSON is null."""
    return _rewritten(document, lambda x: x, ordered=True)
