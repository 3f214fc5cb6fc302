"""URIs of namespaces, schemas, records and attributes: ``scheme://ns/schema/id#attr``, any scheme or none."""

from __future__ import annotations

import re
from dataclasses import dataclass

from tessera.errors import TesseraError

SCHEME = "tessera://"
_SCHEME = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*://")
_PART = re.compile(r"[^/#\s]+")


@dataclass(frozen=True)
class URI:
    ns: str
    schema: str | None = None
    id: str | None = None
    attr: str | None = None

    @property
    def path(self) -> str:
        return "/".join(x for x in (self.ns, self.schema, self.id) if x is not None)

    @property
    def record(self) -> str:
        """The record's path; a URI that names no record is refused."""
        if self.id is None:
            raise TesseraError("INVALID_URI", f"{self} does not name a record", uri=str(self))
        return self.path

    def __str__(self) -> str:
        return SCHEME + self.path + (f"#{self.attr}" if self.attr else "")


def parse(text: str) -> URI:
    """One to three path parts without slashes, hashes or blanks; an attribute needs a record."""
    body = _SCHEME.sub("", text, count=1) if _SCHEME.match(text) else text
    path, mark, attr = body.partition("#")
    parts = path.split("/")
    bad = not 1 <= len(parts) <= 3 or not all(_PART.fullmatch(p) for p in parts)
    if bad or (mark and (len(parts) != 3 or not _PART.fullmatch(attr))):
        raise TesseraError("INVALID_URI", f"not a valid uri: {text}", uri=text)
    return URI(*parts, **({"attr": attr} if mark else {}))


def in_scope(path: str, scope: str) -> bool:
    """Whether a path is the scope itself or lies under it."""
    return path == scope or path.startswith(scope + "/")


def schema_of(path: str) -> str:
    return "/".join(path.split("/")[:2])


def id_of(path: str) -> str:
    return path.split("/", 2)[2]
