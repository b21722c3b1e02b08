"""Commits of a git repository as sources, by content.

A commit is a tree of (path, blob); a blob is a content, whichever commits and paths have it.  Trees, contents and
statistics are read by tasks, each with a ``git`` of its own over the repository (a folder, or a bare clone, that executors
reach under the path they are given); only the list of commits passes through the driver.  Each distinct blob is read and lexed
once, ever: a store keeps its rows by hash, and the snapshots of any number of commits are joins of trees with those
rows, in a number of jobs that does not depend on the number of commits.

No working tree is touched.
"""

from __future__ import annotations

import subprocess
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import history as hs
from ..schema import Snapshots, stored
from ..shared import written as keep
from . import expressions, golang, types

COMMITS = "snapshot_id string, seq int, date string, subject string"
#: Rows of contents: which reader made them, and its columns.
CONTENT = "blob string, reader string, fact string, a string, b string, c string, d string"
#: Bytes of a content that are read at once from ``git``.
_PIECE = 1 << 20


def run(repo: str, *args: str) -> bytes:
    done = subprocess.run(["git", "-C", repo, *args], capture_output=True)
    if done.returncode:
        raise ValueError(f"git {' '.join(args[:2])}: {done.stderr.decode('utf-8', 'replace').strip()[:200]}")
    return done.stdout


def commits(spark: SparkSession, repo: str, n: int = 80, head: str = "HEAD") -> DataFrame:
    """The last n + 1 first-parent commits, oldest first: snapshot_id, seq, date, subject."""
    lines = run(repo, "log", "--first-parent", "-n", str(n + 1), "--format=%H%x09%cs%x09%s", head).decode("utf-8", "replace").splitlines()
    rows = [(sha, i, date, subject) for i, (sha, date, subject) in enumerate(x.split("\t", 2) for x in reversed(lines))]
    return spark.createDataFrame(rows, COMMITS)


def _lines_of(repo: str, *args: str):
    """Output of git by NUL-ended records, as it comes."""
    with subprocess.Popen(["git", "-C", repo, *args], stdout=subprocess.PIPE, stderr=subprocess.PIPE) as p:
        rest = b""
        while piece := p.stdout.read(_PIECE):
            *whole, rest = (rest + piece).split(b"\0")
            yield from whole
        told = p.stderr.read()
    if p.returncode:
        raise ValueError(f"git {' '.join(args[:2])}: {told.decode('utf-8', 'replace').strip()[:200]}")


def trees(repo: str, shas: DataFrame) -> DataFrame:
    """(snapshot_id, path, blob) of the Go files and module files of commits (snapshot_id)."""

    def read(batches):
        import pyarrow as pa

        for b in batches:
            for sha in b.column("snapshot_id").to_pylist():
                out = []
                for line in _lines_of(repo, "ls-tree", "-r", "-z", sha):
                    head, _, path = line.partition(b"\t")
                    mode, kind, blob = head.split()
                    path = path.decode("utf-8", "replace")
                    if kind == b"blob" and mode != b"120000" and (path.endswith(".go") or path.rsplit("/", 1)[-1] == "go.mod"):
                        out.append((sha, path, blob.decode()))
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in (zip(*out, strict=True) if out else [[]] * 3)], names=["snapshot_id", "path", "blob"])

    parallel = shas.sparkSession.sparkContext.defaultParallelism
    return shas.select("snapshot_id").repartition(parallel).mapInArrow(read, "snapshot_id string, path string, blob string")


def _content_rows(source: str, is_module: bool) -> list[tuple]:
    if is_module:
        name = next((x.split()[1].strip('"') for x in source.splitlines() if x.startswith("module ") and len(x.split()) > 1), "")
        return [("module", "module", name, "", "", "")]
    facts = [("facts", *f, "") for f in golang.facts(source)]
    shapes = [("shapes", *r) for r in expressions.expression_rows(source)]
    package = next((f[2] for f in facts if f[1] == "package"), "")
    tokens = golang.lex(source)
    depth = sum((x in ("(", "[", "{")) - (x in (")", "]", "}")) for x in tokens)
    wrong = "no package clause" if not package else "brackets that do not match" if depth else ""
    return facts + shapes + ([("error", "error", wrong, "", "", "")] if wrong else [])


def contents(repo: str, blobs: DataFrame) -> DataFrame:
    """Rows of blobs(blob, module): each content is read once, and passes through one task's memory."""

    def read(batches):
        import pyarrow as pa

        p = subprocess.Popen(["git", "-C", repo, "cat-file", "--batch"], stdin=subprocess.PIPE, stdout=subprocess.PIPE)
        try:
            for b in batches:
                for blob, module in zip(b.column("blob").to_pylist(), b.column("module").to_pylist(), strict=True):
                    p.stdin.write(f"{blob}\n".encode())
                    p.stdin.flush()
                    head = p.stdout.readline().split()
                    if len(head) != 3:
                        raise ValueError(f"git cat-file: {blob} is missing")
                    body = p.stdout.read(int(head[2]))
                    p.stdout.read(1)
                    rows = [(blob, *r) for r in _content_rows(body.decode("utf-8", "replace"), module)]
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in (zip(*rows, strict=True) if rows else [[]] * 7)], names=["blob", "reader", "fact", "a", "b", "c", "d"])
        finally:
            p.stdin.close()
            p.stdout.close()
            p.wait()

    parallel = blobs.sparkSession.sparkContext.defaultParallelism
    return blobs.select("blob", "module").repartition(4 * parallel, "blob").mapInArrow(read, CONTENT)


class Contents:
    """Rows of distinct blobs, in the shared folder ``at``.  A batch counts once its list of blobs is written, which comes
    last: what a broken run has left is not seen."""

    def __init__(self, spark: SparkSession, at: str):
        self.spark, self.rows_at, self.blobs_at = spark, f"{at}/content", f"{at}/blob"

    def _read(self, at: str, kinds: str) -> DataFrame:
        from pyspark.errors import AnalysisException

        try:
            return self.spark.read.schema(kinds).parquet(at)
        except AnalysisException as e:
            if e.getCondition() == "PATH_NOT_FOUND":
                return self.spark.createDataFrame([], kinds)
            raise

    def blobs(self) -> DataFrame:
        """(blob, batch) of what the store has."""
        return self._read(self.blobs_at, "blob string, batch string")

    def rows(self, reader: str) -> DataFrame:
        """(blob, fact, a, b, c, d) of one reader."""
        kinds = "blob string, fact string, a string, b string, c string, d string, batch string, reader string"
        return self._read(self.rows_at, kinds).where(F.col("reader") == reader).join(self.blobs(), ["blob", "batch"], "left_semi").select("blob", "fact", "a", "b", "c", "d")

    def add(self, repo: str, wanted: DataFrame) -> None:
        """Reads those of wanted(blob, module) that the store does not have."""
        new = keep(wanted.join(self.blobs(), "blob", "left_anti"))
        if new.isEmpty():
            return
        batch = uuid.uuid4().hex
        contents(repo, new).withColumn("batch", F.lit(batch)).write.partitionBy("reader", "batch").mode("append").parquet(self.rows_at)
        new.select("blob", F.lit(batch).alias("batch")).write.mode("append").parquet(self.blobs_at)


def modules_of(tree: DataFrame, rows: DataFrame) -> DataFrame:
    """(snapshot_id, module, base): the module at the root, or else the one nearest to it, and its folder."""
    named = rows.where("fact = 'module'").select("blob", F.col("a").alias("module"))
    own = tree.where("path = 'go.mod' or endswith(path, '/go.mod')").join(named, "blob").withColumn("base", F.regexp_replace("path", "/?go\\.mod$", ""))
    order = F.struct(F.size(F.split("path", "/")).alias("depth"), "path")
    return own.groupBy("snapshot_id").agg(F.min_by(F.struct("module", "base"), order).alias("m")).select("snapshot_id", "m.*")


def package_files(tree: DataFrame, modules: DataFrame) -> DataFrame:
    """(snapshot_id, pkg, dir, file, test, blob): the module's files, without folders that the toolchain leaves out and without
    nested modules.  A commit that has no module file is a module without a name."""
    go = tree.where("endswith(path, '.go')").join(modules, "snapshot_id", "left").na.fill("", ["module", "base"])
    inside = go.where((F.col("base") == "") | F.startswith("path", F.concat("base", F.lit("/")))).withColumn("path", F.when(F.col("base") == "", F.col("path")).otherwise(F.substr("path", F.length("base") + 2)))
    nested = tree.where("endswith(path, '/go.mod')").join(modules, "snapshot_id").where((F.col("base") == "") | F.startswith("path", F.concat("base", F.lit("/"))))
    nested = nested.select("snapshot_id", F.regexp_replace(F.when(F.col("base") == "", F.col("path")).otherwise(F.substr("path", F.length("base") + 2)), "/?go\\.mod$", "").alias("up")).where("up <> ''")
    inside = inside.where(golang.built("path")).select("snapshot_id", "module", "path", "blob", *[c.alias(n) for n, c in golang.placed_files(F.col("path")).items()])
    # The folders above a file, of which none may be another module's.
    parts = F.split("dir", "/")
    above = inside.where("dir <> ''").select("snapshot_id", "path", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).alias("up"))
    foreign = above.join(nested, ["snapshot_id", "up"], "left_semi").select("snapshot_id", "path").distinct()
    own = inside.join(foreign, ["snapshot_id", "path"], "left_anti")
    return own.select("snapshot_id", golang.package_path(F.col("module"), F.col("dir")).alias("pkg"), "dir", "file", "test", "blob", "module")


def errors_of(files: DataFrame, facts: DataFrame, errors: DataFrame) -> DataFrame:
    """(snapshot_id, path, message): files that cannot be read, folders with several packages, imports of the module's
    own packages that are not there."""
    broken = files.join(errors.select("blob", F.col("a").alias("message")), "blob").select("snapshot_id", F.concat_ws("/", "pkg", "file").alias("path"), "message")
    code = files.where("not test")
    names = code.join(facts.where("fact = 'package'").select("blob", "a"), "blob").groupBy("snapshot_id", "pkg").agg(F.array_sort(F.collect_set("a")).alias("names")).where("size(names) > 1")
    several = names.select("snapshot_id", F.col("pkg").alias("path"), F.concat(F.lit("packages "), F.array_join("names", ", ")).alias("message"))
    asked = code.join(facts.where("fact = 'import'").select("blob", F.col("a").alias("target")), "blob").where((F.col("module") != "") & ((F.col("target") == F.col("module")) | F.startswith("target", F.concat("module", F.lit("/")))))
    absent = asked.join(code.select("snapshot_id", F.col("pkg").alias("target")).distinct(), ["snapshot_id", "target"], "left_anti").select("snapshot_id", F.col("pkg").alias("path"), F.concat(F.lit("no package "), "target").alias("message")).distinct()
    return broken.unionByName(several).unionByName(absent)


def extracted(spark: SparkSession, repo: str, shas: DataFrame, at: str) -> tuple[Snapshots, DataFrame]:
    """The snapshots of commits (snapshot_id), and their errors; contents are kept in ``at``."""
    tree, held = keep(trees(repo, shas)), Contents(spark, at)
    held.add(repo, tree.groupBy("blob").agg(F.max(~F.endswith("path", F.lit(".go"))).alias("module")))
    modules = modules_of(tree, held.rows("module"))
    every = shas.select("snapshot_id").join(modules, "snapshot_id", "left").select("snapshot_id", F.coalesce("module", F.lit("")).alias("module"), F.col("snapshot_id").alias("commit"))
    files, facts = keep(package_files(tree, modules)), held.rows("facts")
    rows = files.join(facts, "blob").select("snapshot_id", "file", "dir", "test", "fact", "a", "b", "c")
    shapes = types.placed(held.rows("shapes").withColumnRenamed("blob", "key"), files.withColumnRenamed("blob", "key"))
    return golang.snapshots(rows, keep(every), shapes), errors_of(files, facts, held.rows("error"))


def extract_at(spark: SparkSession, repo: str, commit: str, at: str | None = None) -> Snapshots:
    """The snapshot of a commit; the commit is named by its hash."""
    from ..shared import shared_dir

    sha = run(repo, "rev-parse", commit).decode().strip()
    one = spark.createDataFrame([(sha,)], "snapshot_id string")
    return extracted(spark, repo, one, at or f"{shared_dir(spark)}/lattica-contents-{uuid.uuid4().hex}")[0]


def numstat(repo: str, pairs: DataFrame) -> DataFrame:
    """(pair_id, text) of ``git diff --numstat`` between commits: pairs(pair_id, a, b)."""

    def read(batches):
        import pyarrow as pa

        for b in batches:
            for name, old, new in zip(*[b.column(c).to_pylist() for c in ("pair_id", "a", "b")], strict=True):
                lines = run(repo, "diff", "--numstat", old, new).decode("utf-8", "replace").splitlines()
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(lines), pa.string()), pa.array(lines, pa.string())], names=["pair_id", "text"])

    parallel = pairs.sparkSession.sparkContext.defaultParallelism
    return pairs.select("pair_id", "a", "b").repartition(parallel).mapInArrow(read, "pair_id string, text string")


def store(spark: SparkSession, repo: str, shas: DataFrame, at: str) -> Snapshots:
    """A Parquet store of commits (snapshot_id), with their errors and the rows of all contents.  Commits that it has are not
    extracted again, and contents that it has are not read again for new ones."""
    held = stored(spark, at)
    new = keep(shas.select("snapshot_id").distinct() if held is None else shas.select("snapshot_id").distinct().join(held, "snapshot_id", "left_anti"))
    if not new.isEmpty():
        s, errors = extracted(spark, repo, new, at)
        counted = new.join(errors.groupBy("snapshot_id").agg(F.count("*").alias("n")), "snapshot_id", "left").select("snapshot_id", F.coalesce("n", F.lit(0)).cast("int").alias("n_errors"))
        counted.write.partitionBy("snapshot_id").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(f"{at}/errors")
        s.write(at)
    return Snapshots.read(spark, at)


def history(spark: SparkSession, repo: str, n: int, at: str) -> DataFrame:
    """The history report of the last n changes; snapshots are kept in the store ``at``."""
    order = keep(commits(spark, repo, n))
    s, pairs = store(spark, repo, order, at), keep(hs.consecutive(order))
    text = hs.numstat(numstat(repo, pairs))
    errors = spark.read.schema("n_errors int, snapshot_id string").parquet(f"{at}/errors").select("snapshot_id", "n_errors")
    return hs.report(pairs, hs.sizes(s, pairs), text, order.select("snapshot_id", "date", "subject"), errors)
