"""Stops stored on first use and renewed by age, published as whole versions.

A cache folder holds versions of the table and numbered manifests, each naming one version.
A version is written first and its manifest last, so readers see the old version until the
new one is whole, and an interrupted refresh changes nothing. The version before the
present one is kept for readers that have begun on it.
"""

from __future__ import annotations

import datetime as dt
import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from paragem.sources.files import Files
from paragem.sources.tables import SCHEMA_FOLDER, read_stops, write_stops

#: Readers of Parquet pass over names that begin so.
VERSIONS, MANIFESTS = "_versions", "_manifests"
#: Age from which on a version without manifest is taken for the rest of an interrupted refresh.
ABANDONED = dt.timedelta(days=1)


class ForeignFolder(FileExistsError):
    """The folder holds files that this cache has not written."""


@dataclass(frozen=True)
class Version:
    number: int
    path: str
    written_at: dt.datetime


def _now() -> dt.datetime:
    return dt.datetime.now(dt.UTC)


def versions(spark: SparkSession, path: str) -> list[Version]:
    """The published versions whose manifests are kept, the present one last."""
    root = path.rstrip("/")
    files, out = Files(spark, root), []
    for entry in files.entries(f"{root}/{MANIFESTS}"):
        if entry.name.endswith(".json") and not entry.name.startswith("."):
            told = json.loads(files.read_text(entry.path))
            at = dt.datetime.fromisoformat(told["written_at"])
            out.append(Version(int(entry.name.removesuffix(".json")), f"{root}/{VERSIONS}/{told['version']}", at))
    return sorted(out, key=lambda v: v.number)


def refresh(
    spark: SparkSession, path: str, extract: Callable[[], DataFrame], now: Callable[[], dt.datetime] = _now
) -> Version:
    """Extract anew, store as a version of its own and publish it; older ones than the last are removed.

    Of two refreshes at the same time that with the later manifest counts; the other, if it
    finds its number taken, fails and leaves its version to be removed as abandoned.
    """
    root = path.rstrip("/")
    files = Files(spark, root)
    own = {VERSIONS, MANIFESTS}
    found = [e.name for e in files.entries(root)]
    if found and not own.intersection(found) and SCHEMA_FOLDER not in found:
        raise ForeignFolder(f"{path} holds {found[0]} and no table of stops")
    known = versions(spark, root)
    name = f"v-{uuid.uuid4().hex}"
    written_at = now()
    write_stops(extract(), f"{root}/{VERSIONS}/{name}")
    number = known[-1].number + 1 if known else 1
    told = json.dumps({"version": name, "written_at": written_at.isoformat()})
    files.write_new(f"{root}/{MANIFESTS}/{number:010d}.json", told)
    _tidy(files, root, known, name, written_at)
    return Version(number, f"{root}/{VERSIONS}/{name}", written_at)


def _tidy(files: Files, root: str, known: list[Version], new: str, now: dt.datetime) -> None:
    """Keep the last of ``known`` and the ``new`` version, remove older and abandoned ones, a manifest before its version."""
    for old in known[:-1]:
        files.delete(f"{root}/{MANIFESTS}/{old.number:010d}.json")
        files.delete(old.path)
    named = {v.path.rsplit("/", 1)[1] for v in known[-1:]} | {new}
    limit = (now - ABANDONED).timestamp() * 1000
    for entry in files.entries(f"{root}/{VERSIONS}"):
        if entry.name not in named and entry.changed < limit:
            files.delete(entry.path)


def stored_at(spark: SparkSession, path: str) -> str | None:
    """The folder of the present version; ``path`` itself where a table was stored without versions; None if neither."""
    known = versions(spark, path)
    if known:
        return known[-1].path
    return path if Files(spark, path).exists(f"{path.rstrip('/')}/{SCHEMA_FOLDER}") else None


def cached(
    spark: SparkSession,
    path: str,
    extract: Callable[[], DataFrame],
    max_age: dt.timedelta | None = None,
    now: Callable[[], dt.datetime] = _now,
) -> DataFrame:
    """Stops stored at ``path``; extracted and stored there first if there are none, or none young enough.

    A folder with other content is refused. A table without versions counts as older than any ``max_age``.
    """
    known = versions(spark, path)
    stored = stored_at(spark, path)
    old = max_age is not None and (not known or now() - known[-1].written_at > max_age)
    if stored is None or old:
        stored = refresh(spark, path, extract, now).path
    return read_stops(spark, stored)


def read_cached(
    spark: SparkSession, path: str, start: dt.date | None = None, end: dt.date | None = None
) -> DataFrame:
    """The present version of a cache, optionally of a date range; folders of other months are skipped."""
    stored = stored_at(spark, path)
    if stored is None:
        raise FileNotFoundError(path)
    return read_stops(spark, stored, start, end)
