"""The filters that metrics share."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def day_start(text: str) -> int:
    """Unix seconds of an ISO date's midnight UTC; a bad date is an error."""
    day = dt.date.fromisoformat(text)
    return int(dt.datetime(day.year, day.month, day.day, tzinfo=dt.timezone.utc).timestamp())


def _pattern(text: str) -> str:
    return text.replace("\\", "\\\\")


@dataclass(frozen=True)
class Filters:
    """since and until are inclusive ISO days; author and path may hold the wildcards % and _."""

    since: str | None = None
    until: str | None = None
    author: str | None = None
    path: str | None = None
    languages: str | None = None

    def __post_init__(self) -> None:
        for day in (self.since, self.until):
            if day is not None:
                day_start(day)

    def commits(self, commits: DataFrame, authors: DataFrame | None = None) -> DataFrame:
        """Commits in the range, by a matching author; authors are joined only if one is asked for."""
        if self.since is not None:
            commits = commits.filter(F.col("authored_at") >= day_start(self.since))
        if self.until is not None:
            commits = commits.filter(F.col("authored_at") < day_start(self.until) + 86400)
        if self.author is not None and authors is not None:
            like = "%" + _pattern("".join(c.lower() if c.isascii() else c for c in self.author)) + "%"
            found = authors.filter(F.lower("canonical_name").like(like) | F.lower("canonical_email").like(like))
            commits = commits.join(found.select(F.col("id").alias("author_id")), "author_id", "left_semi")
        return commits

    def paths(self, column: str = "path") -> Column:
        """Paths that begin with the prefix; a plain prefix reaches the scan."""
        if self.path is None:
            return F.lit(True)
        if "%" in self.path or "_" in self.path:
            return F.col(column).like(_pattern(self.path) + "%")
        return F.startswith(F.col(column), F.lit(self.path))

    def language(self, column: str = "language") -> Column:
        wanted = [w.strip().lower() for w in (self.languages or "").split(",") if w.strip()]
        return F.lower(F.col(column)).isin(wanted) if wanted else F.lit(True)


NONE = Filters()
