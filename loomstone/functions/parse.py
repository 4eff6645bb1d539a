"""Commit messages, trailers, identities and ignore lists as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Trailer keys and the roles they give (fixed values).
ROLES = {"co-authored-by": "coauthor", "signed-off-by": "signoff"}


def subject_of(message: Column) -> Column:
    return F.regexp_replace(F.split(F.coalesce(message, F.lit("")), "\n")[0], r"^\s+|\s+$", "")


def commit_type(message: Column) -> Column:
    """struct(msg_type, is_breaking, is_revert) of a message's subject.

    Typed is what has letters alone before its first colon, once one "!" and a closing "(scope)" are
    taken off; anything else is untyped and not breaking.
    """
    subject = subject_of(message)
    has_colon = F.contains(subject, F.lit(":"))
    head = F.regexp_replace(F.split_part(subject, F.lit(":"), F.lit(1)), r"^\s+|\s+$", "")
    bang = F.endswith(head, F.lit("!"))
    bare = F.when(bang, F.substring(head, F.lit(1), F.length(head) - 1)).otherwise(head)
    unscoped = F.regexp_replace(bare, r"^([^(]*)\(.*\)$", "$1")
    kind = F.regexp_replace(unscoped, r"^\s+|\s+$", "")
    typed = has_colon & F.rlike(kind, F.lit("^[A-Za-z]+$"))
    msg_type = F.when(typed, F.lower(kind))
    quoted = F.startswith(subject, F.lit('Revert "')) | F.startswith(subject, F.lit("Revert '"))
    revert = quoted | F.coalesce(msg_type == "revert", F.lit(False))
    return F.struct(msg_type.alias("msg_type"), (typed & bang).alias("is_breaking"), revert.alias("is_revert"))


def ident(value: Column) -> Column:
    """struct(name, email) of "Name <email>", null if it has none.

    An opening bracket without a later closing one drops the row; without an opening one the email
    is empty; outer quotes go; a name must be left.
    """
    strip = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    opened = F.contains(value, F.lit("<"))
    before = F.regexp_replace(value, r"(?s)<[^<]*$", "")
    after = F.substring_index(value, "<", -1)
    closed = F.contains(after, F.lit(">"))
    email = F.when(opened, strip(F.regexp_replace(after, r"(?s)>[^>]*$", ""))).otherwise(F.lit(""))
    name = strip(F.regexp_replace(strip(F.when(opened, before).otherwise(value)), '^"+|"+$', ""))
    good = (~opened | closed) & (name != "")
    return F.when(good, F.struct(name.alias("name"), email.alias("email")))


def trailers(messages: DataFrame, message: str = "message") -> DataFrame:
    """One row per trailer of each message: the columns of `messages`, role, name and email."""
    lines = F.slice(F.split(F.col(message), "\n"), 2, F.greatest(F.size(F.split(F.col(message), "\n")), F.lit(1)))
    rows = messages.withColumn("_line", F.explode(lines))
    key = F.lower(F.regexp_replace(F.split_part("_line", F.lit(":"), F.lit(1)), r"^\s+|\s+$", ""))
    role = F.lit(None).cast("string")
    for word, name in ROLES.items():
        role = F.when(key == word, F.lit(name)).otherwise(role)
    rest = F.regexp_replace(F.expr("substr(_line, instr(_line, ':') + 1)"), r"^\s+|\s+$", "")
    rows = rows.filter(F.contains("_line", F.lit(":"))).withColumns({"role": role, "_who": ident(rest)})
    rows = rows.filter(F.col("role").isNotNull() & F.col("_who").isNotNull())
    return rows.select(*messages.columns, "role", F.col("_who.name").alias("name"), F.col("_who.email").alias("email"))


def ignored_revisions(lines: DataFrame, line: str = "value") -> DataFrame:
    """The distinct revisions (sha) that a list names: comments go, hexadecimal words of four or more stay."""
    words = F.split(F.regexp_replace(F.split_part(F.col(line), F.lit("#"), F.lit(1)), r"^\s+|\s+$", ""), r"\s+")
    found = lines.select(F.explode(words).alias("sha")).select(F.lower("sha").alias("sha"))
    return found.filter(F.rlike("sha", F.lit("^[0-9a-f]{4,}$"))).distinct()
