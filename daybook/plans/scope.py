"""Who asks for what: requests, contexts, filters as one predicate, and the project a folder belongs to."""

from __future__ import annotations

import posixpath
from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daybook.functions.dates import boundary

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Request:
    action: str
    query: str | None = None
    entry_id: str | None = None
    session_id: str | None = None
    since: str | None = None
    until: str | None = None
    scope: str = "project"
    kind: str | None = None
    role: str | None = None
    offset: float = 0


@dataclass(frozen=True)
class Context:
    session_id: str
    cwd: str
    home: str = "/home/user"
    zone: str = "UTC"
    indexing: tuple[int, int] | None = None
    caller_entry_id: str | None = None
    #: The caller's own journal.
    journal: str | None = None


@dataclass(frozen=True)
class Filters:
    session_id: str | None = None
    under: str | None = None
    since: str | None = None
    until: str | None = None
    kinds: tuple[str, ...] = ()
    role: str | None = None

    def predicate(self) -> Column:
        """All that is asked, as one condition on session_id, cwd, ts, kind and role; true if nothing is."""
        parts = []
        if self.session_id is not None:
            parts.append(F.col("session_id") == self.session_id)
        if self.under is not None:
            parts.append(under(F.col("cwd"), self.under))
        if self.since is not None:
            parts.append(F.col("ts") >= self.since)
        if self.until is not None:
            parts.append(F.col("ts") <= self.until)
        if self.kinds:
            parts.append(F.col("kind").isin(*self.kinds))
        if self.role is not None:
            parts.append(F.col("role") == self.role)
        return reduce(and_, parts, F.lit(True))


def under(cwd: Column, root: str) -> Column:
    """cwd is the folder or below it; below, ASCII letters match in either case."""
    root = root.rstrip("/")
    ascii_lower = str.maketrans(UPPER, LOWER)
    return (cwd == root) | F.translate(cwd, UPPER, LOWER).startswith(root.translate(ascii_lower) + "/")


def project_root(cwd: str, known: Iterable[str], home: str) -> str:
    """Inside home: the outermost known folder above cwd that is no direct child of home; else cwd itself."""
    target, base = posixpath.normpath(cwd), posixpath.normpath(home)
    if not target.startswith(base.rstrip("/") + "/"):
        return target
    seen = {posixpath.normpath(k) for k in known}
    above, at = [], target
    while at not in (base, "/"):
        above.append(at)
        at = posixpath.dirname(at)
    return next((a for a in reversed(above) if a == target or (a in seen and posixpath.dirname(a) != base)), target)


def project_roots(folders: DataFrame, home: str) -> DataFrame:
    """(cwd, project) of every distinct folder at once: each folder's ancestors are joined with the known folders by
    equality, and the shortest that counts is taken."""
    base = home.rstrip("/")
    known = folders.select("cwd").where("cwd IS NOT NULL").distinct()
    parts = F.split("cwd", "/")
    above = known.select("cwd", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).alias("a"))
    inside = above.where(F.col("a").startswith(base + "/"))
    counts = inside.join(known.select(F.col("cwd").alias("a"), F.lit(True).alias("k")), "a", "left").where(
        (F.col("a") == F.col("cwd")) | (F.col("k") & (F.size(F.split("a", "/")) > len(base.split("/")) + 1))
    )
    best = counts.groupBy("cwd").agg(F.min_by("a", F.length("a")).alias("project"))
    return known.join(best, "cwd", "left").select("cwd", F.coalesce("project", "cwd").alias("project"))


def filters_for(request: Request, context: Context, cwds: Iterable[str], kinds: tuple[str, ...] = ()) -> tuple[Filters, dict]:
    """The filters of a request, and what is said about its scope."""
    root = project_root(context.cwd, cwds, context.home) if request.scope == "project" else None
    session = (request.session_id or context.session_id) if request.scope == "session" else request.session_id
    filters = Filters(
        session, root, boundary(request.since, False, context.zone), boundary(request.until, True, context.zone),
        kinds or ((request.kind,) if request.kind else ()), request.role,
    )
    return filters, {"scope": request.scope} | ({"project": root} if root else {})
