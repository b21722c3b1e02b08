"""Column expressions over package paths, ids and names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Prefixes of synthetic nodes and the tags that reports give them (fixed values).
NODE_TAGS = {"api:": "endpoint", "service:": "service", "cap:": "capability", "env:": "config", "flag:": "config"}
#: Standard library names that count as notable external targets (fixed values).
NOTABLE_STDLIB = ("net", "net/http", "database/sql", "os/exec", "syscall", "unsafe", "plugin", "crypto/tls", "net/rpc", "os", "reflect")
OPERATIONAL = ("config", "service", "capability", "protocol")
STRATA = ("feat", "fix", "refactor", "test", "hardening", "perf", "docs", "chore", "build", "other")


def is_internal(path, module) -> Column:
    return (path == module) | F.startswith(path, F.concat(module, F.lit("/")))


def short(path) -> Column:
    return F.substring_index(path, "/", -1)


def rel(path, module) -> Column:
    """The path without the module prefix; the module itself is ''."""
    return F.when(path == module, "").when(F.startswith(path, F.concat(module, F.lit("/"))), F.substr(path, F.length(module) + 2)).otherwise(path)


def component(relative, depth: int) -> Column:
    """The first ``depth`` segments; the module itself is (root)."""
    return F.when(relative == "", "(root)").otherwise(F.substring_index(relative, "/", depth))


def owner(ident) -> Column:
    """The package of an id ``path.Name``: what stands before the last dot."""
    return F.regexp_replace(ident, r"\.[^.]*$", "")


def short_package(path) -> Column:
    """Without host, organisation and repository where the first segment is a host."""
    parts = F.split(path, "/")
    return F.when((F.instr(parts[0], ".") > 0) & (F.size(parts) >= 3), F.when(F.size(parts) == 3, parts[2]).otherwise(F.array_join(F.slice(parts, 4, 1000), "/"))).otherwise(path)


def node_tag(path, internal) -> Column:
    tag = None
    for prefix, name in NODE_TAGS.items():
        hit = F.startswith(path, F.lit(prefix))
        tag = F.when(hit, name) if tag is None else tag.when(hit, name)
    return tag.when(~internal, "external").otherwise("")


def notable(dst, kind) -> Column:
    return kind.isin(*OPERATIONAL) | (F.instr(F.split(dst, "/")[0], ".") > 0) | dst.isin(*NOTABLE_STDLIB)


def stratum(subject) -> Column:
    head = F.lower(F.trim(F.split(F.split(subject, r"\(")[0], ":")[0]))
    return F.when(head.isin(*STRATA[:-1]), head).otherwise("other")


def digest12(text) -> Column:
    return F.substring(F.sha2(text, 256), 1, 12)


def capped(items, n: int) -> Column:
    """The first n of a list, and how many more there are."""
    more = F.size(items) - n
    return F.when(more > 0, F.concat(F.array_join(F.slice(items, 1, n), ", "), F.lit(", …(+"), more.cast("string"), F.lit(" more)"))).otherwise(F.array_join(items, ", "))


def joined(column, sep: str = ",") -> Column:
    """Aggregate: the distinct values, sorted, as one string."""
    return F.array_join(F.array_sort(F.collect_set(column)), sep)
