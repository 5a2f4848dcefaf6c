"""Which folders of a table are valid: a base for each part, and the batches saved after it.

A table grows by a folder for each batch. Rolling a part writes one base that stands for all its batches up to some id, and
then names it in the next version of the table's manifest. Versions are numbered files; a version appears in one step, and
readers take the newest. So a reader sees the batches alone, or the base with the batches after it, never neither and
never both. Folders that no kept version names are removed by ``expire``, some versions later, when no reader is left in them.

A batch may be repeated only while it is the last one of its job, so a roll takes all batches but the last. One roll at a time
follows a version: it claims it first. A roll that died leaves its claim, which ``release`` removes.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable, Iterable
from typing import NamedTuple

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from rtshop.session import shuffles_dropped
from rtshop.sources.files import Store

# Spark does not list folders that begin with an underscore, so bases and manifests are no rows of the table's batches.
FOLDER, BASES = "_manifest", "_base"


class Part(NamedTuple):
    """A base, relative to the table, and the last batch that it holds."""

    base: str
    after: int


class Manifest(NamedTuple):
    version: int
    parts: dict[str, Part]

    def after(self, part: Column) -> Column:
        """The last batch in the base of the part a row belongs to, -1 without one."""
        if not self.parts:
            return F.lit(-1).cast("bigint")
        pairs = [F.lit(x) for name, known in sorted(self.parts.items()) for x in (name, known.after)]
        return F.coalesce(F.try_element_at(F.create_map(*pairs), part), F.lit(-1)).cast("bigint")


def _versions(store: Store) -> list[int]:
    return sorted(int(name[:-5]) for name in store.names(FOLDER) if re.fullmatch(r"\d+\.json", name))


def _load(store: Store, version: int) -> Manifest:
    parts = json.loads(store.read(f"{FOLDER}/{version:09d}.json"))
    return Manifest(version, {name: Part(*known) for name, known in parts.items()})


def read_manifest(spark: SparkSession, path: str) -> Manifest:
    """The newest version; version 0 without bases where nothing was rolled yet."""
    store = Store(spark, path)
    versions = _versions(store)
    return _load(store, versions[-1]) if versions else Manifest(0, {})


def batches(spark: SparkSession, path: str, pattern: str) -> list[int]:
    """Ids of the batches that are there; ``pattern`` names the folders above them, as ``dt=*``."""
    found = Store(spark, path).matching(f"{pattern}/_batch_id=*")
    return sorted({int(name.rsplit("=", 1)[1]) for name in found})


def roll(spark: SparkSession, path: str, pattern: str, parts: Iterable[str],
         write_base: Callable[[str, Manifest, int], None]) -> Manifest:
    """Write a base for ``parts`` and make it valid in one step; jobs may write and readers read meanwhile.

    ``write_base(folder, manifest, upto)`` writes all that the old manifest's bases and the batches up to ``upto`` hold of
    the parts. Raises where another roll follows the same version. Without a batch to roll nothing happens.
    """
    store, old = Store(spark, path), read_manifest(spark, path)
    upto = max(batches(spark, path, pattern)[:-1], default=-1)
    due = [p for p in parts if old.parts.get(p, Part("", -1)).after < upto]
    if not due:
        return old
    if not store.create(f"{FOLDER}/{old.version:09d}.claim"):
        raise RuntimeError(f"another roll follows version {old.version} of {path}")
    base = f"{BASES}/{uuid.uuid4().hex}"
    with shuffles_dropped(spark):
        write_base(f"{store.root}/{base}", old, upto)
    new = Manifest(old.version + 1, {**old.parts, **{p: Part(base, upto) for p in due}})
    store.write(f"{FOLDER}/{new.version:09d}.json", json.dumps(new.parts))
    return new


def release(spark: SparkSession, path: str) -> None:
    """Remove the claim of a roll that died before its version appeared."""
    Store(spark, path).delete(f"{FOLDER}/{read_manifest(spark, path).version:09d}.claim")


def expire(spark: SparkSession, path: str, part_folder: Callable[[str], str], keep: int = 2) -> None:
    """Remove what none of the newest ``keep`` versions needs: older manifests, their bases, and batches in all bases.

    ``part_folder(part)`` is the folder pattern above the batches of a part. A reader that began ``keep`` rolls ago must
    have ended.
    """
    store = Store(spark, path)
    versions = _versions(store)
    kept = [_load(store, v) for v in versions[-keep:]]
    if len(kept) < keep:
        return
    bases = {known.base for m in kept for known in m.parts.values()}
    for name in store.names(BASES):
        if f"{BASES}/{name}" not in bases and not _being_written(store, kept[-1].version):
            store.delete(f"{BASES}/{name}")
    for part in kept[-1].parts:
        after = min(m.parts.get(part, Part("", -1)).after for m in kept)
        for folder in store.matching(f"{part_folder(part)}/_batch_id=*"):
            if int(folder.rsplit("=", 1)[1]) <= after:
                store.delete(folder)
    for version in versions[:-keep]:
        for suffix in ("json", "claim"):
            store.delete(f"{FOLDER}/{version:09d}.{suffix}")


def _being_written(store: Store, version: int) -> bool:
    """A roll that follows the newest version may be writing a base that no version names yet."""
    return f"{version:09d}.claim" in store.names(FOLDER)
