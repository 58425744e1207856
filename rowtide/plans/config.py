"""Table properties: opt-in, key columns, watermark, and protection against drift."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from rowtide.functions.keys import comma_list

PRIMARY_KEYS = "rowtide.primary-keys"
INDEX_BUCKETS = "rowtide.index-buckets"
LAST_SEQ, LAST_KIND = "rowtide.last-processed-sequence", "rowtide.last-processed-kind"
#: The version a run was planned on: files of later versions must lie past the watermark.
LAST_VERSION = "rowtide.last-processed-version"
PINNED_KEYS, PINNED_BUCKETS = "rowtide.pinned-primary-keys", "rowtide.pinned-index-buckets"
DATA_FORMAT, DELETE_FORMAT = "write.format.default", "write.delete.format.default"
DELETE_TARGET, DEFAULT_DELETE_TARGET = "rowtide.delete-target-file-bytes", 512 << 20
CONVERTED = "rowtide-converted"
DEFAULT_BUCKETS = 1
FORMAT_VERSIONS = (2, 3)
KINDS = ("EQ_DEL", "DATA")


class ConfigError(ValueError):
    """A table that must not be processed as it is configured."""


class LateCommit(ConfigError):
    """A file that was committed after the walk had passed its place; the index has to be made anew from an earlier watermark."""


@dataclass(frozen=True, order=True)
class State:
    """A place in the walk: all files up to it are processed. Kinds order EQ_DEL before DATA."""

    seq: int = 0
    kind: int = 1

    @classmethod
    def of(cls, properties: Mapping[str, str]) -> State:
        if LAST_SEQ not in properties:
            return cls()
        return cls(int(properties[LAST_SEQ]), KINDS.index(properties.get(LAST_KIND, "DATA")))

    def properties(self) -> dict[str, str]:
        return {LAST_SEQ: str(self.seq), LAST_KIND: KINDS[self.kind]}


@dataclass(frozen=True)
class TableConfig:
    primary_keys: tuple[str, ...]
    buckets: int = DEFAULT_BUCKETS

    @classmethod
    def of(cls, properties: Mapping[str, str]) -> TableConfig:
        keys = tuple(comma_list(properties.get(PRIMARY_KEYS)))
        if not keys:
            raise ConfigError(f"{PRIMARY_KEYS} names no column")
        buckets = int(properties.get(INDEX_BUCKETS, DEFAULT_BUCKETS))
        if buckets < 1:
            raise ConfigError(f"{INDEX_BUCKETS} must be positive")
        return cls(keys, buckets)

    def pinned(self) -> dict[str, str]:
        return {PINNED_KEYS: ",".join(self.primary_keys), PINNED_BUCKETS: str(self.buckets)}

    def check_stable(self, properties: Mapping[str, str]) -> None:
        """Keys and buckets must be those of the first run; an unset bucket count equals its default."""
        if PINNED_KEYS in properties and tuple(comma_list(properties[PINNED_KEYS])) != self.primary_keys:
            raise ConfigError(f"primary-keys changed from {properties[PINNED_KEYS]} to {','.join(self.primary_keys)}")
        if PINNED_BUCKETS in properties and int(properties[PINNED_BUCKETS]) != self.buckets:
            raise ConfigError(f"index-buckets changed from {properties[PINNED_BUCKETS]} to {self.buckets}")


def check_version(format_version: int) -> None:
    if format_version not in FORMAT_VERSIONS:
        raise ConfigError(f"format-version {format_version} is not one of {FORMAT_VERSIONS}")


def delete_format(properties: Mapping[str, str]) -> str:
    """The format of position deletes: that of deletes, else that of data, else parquet."""
    return properties.get(DELETE_FORMAT) or properties.get(DATA_FORMAT) or "parquet"


def delete_target(properties: Mapping[str, str]) -> int:
    """The size beyond which position deletes of one data file go into another delete file."""
    n = int(properties.get(DELETE_TARGET, DEFAULT_DELETE_TARGET))
    if n < 1:
        raise ConfigError(f"{DELETE_TARGET} must be positive")
    return n
