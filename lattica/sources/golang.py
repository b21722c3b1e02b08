"""Facts from Go sources, without a Go toolchain.

``scan`` reads ``.go`` files on the executors and lexes each into fact rows (``mapInPandas``); everything after that is
relational.  Given rows of ``expressions`` as well, method sets follow embedding, and calls and tests are resolved by the types of
expressions (``types``).  Types of other modules are known by name alone.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths as P
from ..operators.delta import few
from ..schema import Snapshots
from ..shared import written as keep
from . import types

FACT = "file string, dir string, test boolean, fact string, a string, b string, c string"

# Rules of what is recognised.
FLAG_KEY_FIRST = ("String", "Bool", "Int", "Int64", "Uint", "Uint64", "Float64", "Duration", "Func", "BoolFunc")
FLAG_KEY_SECOND = ("TextVar", "Var", "StringVar", "BoolVar", "IntVar", "Int64Var", "UintVar", "Uint64Var", "Float64Var", "DurationVar")
HTTP_VERBS = ("GET", "POST", "PUT", "DELETE", "PATCH", "HEAD", "OPTIONS", "CONNECT", "TRACE")
SERDE_TAGS = ("json:", "gob:", "db:", "bson:", "xml:", "yaml:", "protobuf:", "avro:", "mapstructure:")
SERVICES = {
    "github.com/jackc/pgx": "Postgres", "github.com/lib/pq": "Postgres", "github.com/bradfitz/gomemcache": "Memcached", "github.com/elastic/go-elasticsearch": "Elasticsearch",
    "github.com/olivere/elastic": "Elasticsearch", "github.com/redis/go-redis": "Redis", "github.com/go-redis/redis": "Redis", "github.com/gomodule/redigo": "Redis",
    "github.com/confluentinc/confluent-kafka-go": "Kafka", "github.com/segmentio/kafka-go": "Kafka", "github.com/IBM/sarama": "Kafka", "github.com/Shopify/sarama": "Kafka",
    "github.com/rabbitmq/amqp091-go": "RabbitMQ", "github.com/streadway/amqp": "RabbitMQ", "github.com/hashicorp/vault": "Vault", "go.mongodb.org/mongo-driver": "MongoDB", "github.com/aws/aws-sdk-go": "AWS",
}

_LEX = re.compile(r"""(?P<skip>[ \t\r]+|//[^\n]*|/\*.*?\*/)|(?P<str>"(?:\\.|[^"\\\n])*"|`[^`]*`|'(?:\\.|[^'\\\n])*')|(?P<id>[^\W\d]\w*)|(?P<num>\d[\w.]*)|(?P<nl>\n)|(?P<op>:=|\.\.\.|<-|.)""", re.S)


def lex(source: str) -> list[str]:
    """Tokens, comments and blanks gone, line ends kept."""
    return [m[0] for m in _LEX.finditer(source) if m.lastgroup != "skip"]


def _close(t: list[str], i: int) -> int:
    """The index after the bracket that closes the one at i."""
    depth = 0
    for j in range(i, len(t)):
        depth += (t[j] in "([{") - (t[j] in ")]}") if len(t[j]) == 1 else 0
        if depth == 0:
            return j + 1
    return len(t)


def _spell(t: list[str]) -> str:
    return re.sub(r" ?([().,\[\]*{}]) ?", r"\1", " ".join(x for x in t if x != "\n")).replace(",", ", ")


def facts(source: str) -> list[tuple[str, str, str, str]]:
    """(fact, a, b, c) rows of one file: package, import(path, name), func(name, receiver, signature), type(name, kind),
    method(interface, name, signature), field(type, name, tag), value(name, kind), test(name, hash), use(alias, name,
    in function), call(alias.name, literal of argument 0, of argument 1)."""
    t, out, i, depth = lex(source), [], 0, 0

    def imports(j: int) -> int:
        group = t[j] == "("
        end = _close(t, j) if group else next((k for k in range(j, len(t)) if t[k] == "\n"), len(t))
        for k in range(j, end):
            if t[k][0] in "\"`":
                path = t[k][1:-1]
                alias = t[k - 1] if t[k - 1] not in ("(", "\n", "import") else re.sub(r"/v\d+$", "", path).rsplit("/", 1)[-1]
                out.append(("import", path, alias, ""))
        return end

    def body(name: str, lo: int, hi: int) -> None:
        for k in range(lo, hi - 2):
            if t[k + 1] == "." and t[k].isidentifier() and t[k + 2].isidentifier() and (k == 0 or t[k - 1] != "."):
                out.append(("use", t[k], t[k + 2], name))
                if k + 3 < hi and t[k + 3] == "(":
                    args, at, end = [""], k + 4, _close(t, k + 3) - 1
                    while at < end:
                        nxt = _close(t, at) if t[at] in ("(", "[", "{") else at + 1
                        if t[at] == ",":
                            args.append("")
                        else:
                            args[-1] += "\0".join(t[at:nxt]) + "\0"
                        at = nxt
                    out.append(("call", f"{t[k]}.{t[k + 2]}", _literal(args[0]), _literal(args[1]) if len(args) > 1 else ""))

    def types(j: int) -> int:
        if t[j] == "(":
            end, j = _close(t, j) - 1, j + 1
            while j < end:
                j = one_type(j) if t[j] != "\n" else j + 1
            return end + 1
        return one_type(j)

    def one_type(j: int) -> int:
        name, j = t[j], j + 1
        if j < len(t) and t[j] == "[" and t[j + 1].isidentifier():
            j = _close(t, j)
        kind = t[j] if j < len(t) else ""
        out.append(("type", name, kind if kind in ("struct", "interface") else "other", ""))
        while j < len(t) and t[j] not in ("\n", "{"):
            j += 1
        if j < len(t) and t[j] == "{":
            end = _close(t, j)
            line: list[str] = []
            k = j + 1
            while k < end:
                if t[k] in ("\n", ";") or k == end - 1:
                    if line and kind == "interface" and len(line) > 1 and line[1] == "(":
                        out.append(("method", name, line[0], _spell(line[1:])))
                    elif line and kind == "struct" and line[-1][0] in "\"`":
                        for n in [x for x in line[: line.index(next((y for y in line[1:] if y != "," and not y.isidentifier()), line[-1]))] if x.isidentifier()][: 1 + line.count(",")]:
                            out.append(("field", name, n, line[-1][1:-1]))
                    line = []
                elif t[k] in "([{":
                    line += t[k : _close(t, k)]
                    k = _close(t, k) - 1
                else:
                    line.append(t[k])
                k += 1
            return end
        return j

    def values(j: int, kind: str) -> int:
        end = _close(t, j) if t[j] == "(" else next((k for k in range(j, len(t)) if t[k] == "\n"), len(t))
        start, k = True, j + (t[j] == "(")
        while k < end:
            if start and t[k].isidentifier():
                out.append(("value", t[k], kind, ""))
                while k + 2 < end and t[k + 1] == "," and t[k + 2].isidentifier():
                    k += 2
                    out.append(("value", t[k], kind, ""))
            start = t[k] == "\n"
            k = _close(t, k) if t[k] in ("(", "[", "{") else k + 1
        return end

    def func(j: int) -> int:
        begin, receiver = j - 1, ""
        if t[j] == "(":
            end = _close(t, j)
            receiver = next((x for x in reversed(t[j:end]) if x.isidentifier()), "")
            j = end
        name, j = t[j], j + 1
        sig = j
        while j < len(t) and t[j] not in ("{", "\n"):
            j = _close(t, j) if t[j] in ("(", "[") or (t[j] in ("interface", "struct") and t[j + 1] == "{") else j + 1
        out.append(("func", name, receiver, _spell(t[sig:j])))
        end = _close(t, j) if j < len(t) and t[j] == "{" else j
        body(f"{receiver}.{name}" if receiver else name, sig, end)
        if not receiver and re.match(r"(Test|Fuzz)(?![a-z])", name) and name != "TestMain":
            out.append(("test", name, hashlib.sha256(" ".join(x for x in t[begin:end] if x != "\n").encode()).hexdigest()[:12], ""))
        return end

    while i < len(t):
        x = t[i]
        if depth == 0 and x == "package" and i + 1 < len(t):
            out.append(("package", t[i + 1], "", ""))
            i += 2
        elif depth == 0 and i + 1 < len(t) and x in ("import", "func", "type", "var", "const"):
            i = {"import": imports, "func": func, "type": types}.get(x, lambda j, x=x: values(j, x))(i + 1)
        else:
            i += 1
    return out


def _literal(arg: str) -> str:
    """The value of a string literal or a sum of them; '' if there is anything else."""
    parts = [x for x in arg.split("\0") if x and x != "\n"]
    if not parts or any((p[0] not in "\"`") if k % 2 == 0 else p != "+" for k, p in enumerate(parts)):
        return ""
    return "".join(p[1:-1] for p in parts[::2])


def sources(spark: SparkSession, root: str) -> DataFrame:
    """(path, content) of all Go files under a folder; paths are relative to it."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.go").option("recursiveFileLookup", True).load(root)
    base = re.sub(r"^file:/+", "/", root.rstrip("/"))
    own = F.regexp_replace("path", "^file:/+", "/")
    return files.select(F.ltrim(F.when(F.startswith(own, F.lit(base)), F.substr(own, F.lit(len(base) + 1))).otherwise(own), F.lit("/")).alias("path"), "content").where(built("path"))


def built(path):
    """Whether the toolchain takes files at this relative path for packages of the module."""
    folders = F.concat(F.lit("/"), F.regexp_replace(path, "[^/]*$", ""))
    return ~folders.rlike("/(testdata|vendor|[._][^/]*)/") & ~F.substring_index(path, "/", -1).rlike("^[._]")


def placed_files(paths) -> dict:
    """dir, file and test of a relative path."""
    name = F.substring_index(paths, "/", -1)
    return {"dir": F.when(F.contains(paths, F.lit("/")), F.regexp_replace(paths, "/[^/]*$", "")).otherwise(""), "file": name, "test": F.endswith(name, F.lit("_test.go"))}


def scan(spark: SparkSession, root: str) -> DataFrame:
    """Fact rows of all Go files under a folder."""
    return rows_of_files(sources(spark, root))


def rows_of_files(files: DataFrame, base: str = "") -> DataFrame:
    """Fact rows of files(path, content); ``base`` is what paths begin with."""

    def run(frames):
        import pandas as pd

        for pdf in frames:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                own = re.sub(r"^file:/+", "/", path).removeprefix(base).lstrip("/")
                folder, _, name = own.rpartition("/")
                rows += [(name, folder, name.endswith("_test.go"), *f) for f in facts(bytes(content).decode("utf-8", "replace"))]
            yield pd.DataFrame(rows, columns=["file", "dir", "test", "fact", "a", "b", "c"])

    return files.mapInPandas(run, FACT)


def module_of(spark: SparkSession, root: str) -> str:
    row = spark.read.text(f"{root}/go.mod").select(F.regexp_extract("value", r"^module\s+(\S+)", 1).alias("m")).where("m <> ''").first()
    return row.m if row else ""


def snapshot(rows: DataFrame, module: str, snapshot_id: str, shapes: DataFrame | None = None) -> Snapshots:
    """The snapshot tables of fact rows; ``shapes`` are the ``expressions`` rows of the same files (key: the path)."""
    spark, lit = rows.sparkSession, F.lit(snapshot_id).alias("snapshot_id")
    modules = few(spark, [(snapshot_id, module, "")], ["snapshot_id", "module", "commit"])
    return snapshots(rows.select(lit, "*"), modules, shapes if shapes is None else shapes.select(lit, "*"))


def package_path(module, folder):
    return F.when(folder == "", module).otherwise(F.concat_ws("/", module, folder))


def snapshots(rows: DataFrame, modules: DataFrame, shapes: DataFrame | None = None) -> Snapshots:
    """The tables of any number of snapshots: fact rows with ``snapshot_id``, modules(snapshot_id, module, commit), and
    typed rows of the same snapshots (``types.placed``).  Without those, methods are known by what a type
    declares, and calls and tests by package names alone."""
    spark, S = rows.sparkSession, "snapshot_id"
    f = rows.join(modules.select(S, "module"), S).withColumn("path", package_path(F.col("module"), F.col("dir"))).drop("module")
    code = f.where("not test")
    exported = lambda c: F.col(c).rlike("^[A-Z]")
    imports = code.where("fact = 'import'").select(S, "path", "file", F.col("a").alias("target"), F.col("b").alias("alias"))
    own = code.select(S, "path").distinct()

    def arrows(df: DataFrame, kind: str, dst, witness) -> DataFrame:
        return df.select(S, F.col("path").alias("src"), F.lit(kind).alias("kind"), dst.alias("dst"), witness.alias("witness")).distinct()

    at = lambda role: F.concat(F.lit(f"{role}@"), F.col("file"))
    funcs = code.where("fact = 'func'").select(S, "path", F.col("a").alias("name"), F.col("b").alias("recv"), F.col("c").alias("sig"))
    calls = code.where("fact = 'call'").select(S, "path", "file", F.split("a", r"\.")[0].alias("alias"), F.split("a", r"\.")[1].alias("name"), F.col("b").alias("x"), F.col("c").alias("y"))
    known = calls.join(imports, [S, "path", "file", "alias"])
    env = arrows(known.where("target = 'os' and name in ('Getenv', 'LookupEnv') and x <> ''"), "config", F.concat(F.lit("env:"), F.col("x")), at("read"))
    flags = known.where("target = 'flag'").select(S, "path", "file", "name", "x", "y")
    kinds = code.where("fact = 'type'").select(S, "path", F.col("a").alias("name"), F.col("b").alias("kind"))
    sets = code.where("fact = 'method'").select(S, F.col("path").alias("ipath"), F.col("a").alias("iface"), F.col("b").alias("name"), F.col("c").alias("sig")).where(exported("iface"))
    if shapes is None:
        use = code.where("fact = 'use'").select(S, "path", "file", F.col("a").alias("alias"), F.col("b").alias("name")).join(imports, [S, "path", "file", "alias"])
        free = funcs.where("recv = ''").where(exported("name")).select(S, F.col("path").alias("target"), "name")
        call = arrows(use.join(free, [S, "target", "name"], "left_semi"), "call", F.col("target"), F.col("name"))
        wanted = sets.groupBy(S, "ipath", "iface").agg(F.count("*").alias("n"))
        # A type implements an interface if it has all of its methods: relational division by counting.
        has = funcs.where("recv <> ''").where(exported("recv")).join(sets, [S, "name", "sig"]).groupBy(S, "path", "recv", "ipath", "iface").agg(F.count_distinct("name").alias("k")).join(wanted, [S, "ipath", "iface"]).where("k = n")
        impl = has.select(S, F.col("path").alias("src"), F.lit("implements").alias("kind"), F.col("ipath").alias("dst"), F.concat_ws(" |= ", "recv", "iface").alias("witness"))
        ifaces = sets.select(S, F.concat_ws(".", "ipath", "iface").alias("id")).distinct()
    else:
        shapes = keep(shapes)
        flat, strange = (keep(x) for x in types.interface_methods(shapes))
        # Members that neither a step selects nor an interface wants are not followed.
        names = types.selected(shapes).unionByName(flat.select("snapshot_id", "name")).distinct()
        inside = keep(types.members(shapes, flat, names))
        typed = keep(types.propagate(shapes, inside))
        refs = types.references(shapes.where("not test"), typed).where(exported("name") & (F.col("pkg") != F.col("target")))
        seen = refs.join(own.withColumnRenamed("path", "target"), [S, "target"], "left_semi").withColumnRenamed("pkg", "path")
        call = arrows(seen, "call", F.col("target"), F.when(F.col("recv") == "", F.col("name")).otherwise(F.concat_ws(".", "recv", "name")))
        done = types.implements(shapes, flat, strange, inside)
        impl = done.select(S, types.package_of("type").alias("src"), F.lit("implements").alias("kind"), types.package_of("iface").alias("dst"), F.concat_ws(" |= ", types.short("type"), types.short("iface")).alias("witness"))
        ifaces = flat.where(types.short("iface").rlike("^[A-Z]")).select(S, F.col("iface").alias("id")).distinct()
        flags = flags.unionByName(types.flag_names(shapes.where("not test"), typed).select(S, F.col("pkg").alias("path"), "file", "name", "x", "y"))
    key = F.when(F.col("name").isin(*FLAG_KEY_FIRST), F.col("x")).when(F.col("name").isin(*FLAG_KEY_SECOND), F.col("y"))
    flag = arrows(flags.withColumn("k", key).where("k <> ''"), "config", F.concat(F.lit("flag:"), F.col("k")), at("define"))
    verb = F.upper("name").isin(*HTTP_VERBS) & F.startswith("x", F.lit("/"))
    cut = F.split(F.trim("x"), r"\s+", 2)
    handle = F.col("name").isin("Handle", "HandleFunc") & cut[0].isin(*HTTP_VERBS) & F.startswith(F.get(cut, F.lit(1)), F.lit("/"))
    route = F.when(verb, F.concat(F.lit("api:"), F.upper("name"), F.lit(" "), F.col("x"))).when(handle, F.concat(F.lit("api:"), cut[0], F.lit(" "), F.trim(F.get(cut, F.lit(1)))))
    api = arrows(calls.withColumn("r", route).where("r is not null"), "protocol", F.col("r"), at("register"))
    rules = spark.createDataFrame(list(SERVICES.items()), "prefix string, service string")
    served = imports.join(F.broadcast(rules), (F.col("target") == F.col("prefix")) | F.startswith("target", F.concat("prefix", F.lit("/"))))
    service = arrows(served, "service", F.concat(F.lit("service:"), F.col("service")), at("import"))
    t = F.col("target")
    cap = F.when(t.isin("unsafe", "reflect", "plugin"), t).when(t == "os/exec", "exec").when((t == "syscall") | F.startswith(t, F.lit("golang.org/x/sys")), "syscall").when((t == "net") | F.startswith(t, F.lit("net/")), "net")
    capability = arrows(imports.withColumn("cap", cap).where("cap is not null"), "capability", F.concat(F.lit("cap:"), F.col("cap")), at("import"))
    witness = arrows(imports, "import", F.col("target"), F.col("file")).unionByName(call.where("src <> dst"))
    for x in (env, flag, api, service, capability):
        witness = witness.unionByName(x)
    witness = witness.unionByName(impl.where("src <> dst")).withColumn("scope", F.lit("cross")).unionByName(impl.where("src = dst").withColumn("scope", F.lit("local")))
    witness = witness.select(S, "src", "kind", "dst", "scope", "witness")
    if shapes is not None:
        witness = keep(witness)  # packages, arrows and witnesses all read it
    zero = F.lit(0).alias("pos")
    # Whatever is not below the module's path is outside.
    ends = witness.where("scope = 'cross'").select(S, F.col("dst").alias("path")).distinct().join(modules.select(S, "module"), S)
    outside = ends.where(~F.startswith("path", F.col("module"))).select(S, "path")
    none = F.lit(None).cast("string").alias("sig")
    symbols = funcs.where("recv = ''").select(S, "path", F.lit("func").alias("kind"), "name", "sig").unionByName(funcs.where("recv <> ''").where(exported("recv")).select(S, "path", F.lit("method").alias("kind"), F.concat_ws(".", "recv", "name").alias("name"), "sig"))
    symbols = symbols.where(F.substring_index("name", ".", -1).rlike("^[A-Z]")).unionByName(kinds.where(exported("name")).select(S, "path", F.lit("type").alias("kind"), "name", none)).unionByName(code.where("fact = 'value'").where(exported("a")).select(S, "path", F.col("b").alias("kind"), F.col("a").alias("name"), none))
    tagged = code.where("fact = 'field'").where(exported("a") & exported("b"))
    hit = F.lit(False)
    for x in SERDE_TAGS:
        hit = hit | F.contains("c", F.lit(x))
    schema = tagged.where(hit).select(S, "path", F.lit("field").alias("kind"), F.concat_ws(".", "a", "b").alias("name"), none)
    both = symbols.withColumn("axis", F.lit("surface")).unionByName(schema.withColumn("axis", F.lit("schema")))
    tests = f.where("test and fact = 'test'").select(S, "path", F.col("a").alias("name"), "file", F.col("b").alias("hash"))
    if shapes is None:
        named = f.where("test and fact = 'use'").select(S, "path", "file", F.col("a").alias("alias"), F.col("b").alias("ref"), F.col("c").alias("name")).join(f.where("test and fact = 'import'").select(S, "path", "file", F.col("a").alias("target"), F.col("b").alias("alias")), [S, "path", "file", "alias"])
        met = named.select(S, "path", "name", F.concat_ws(".", "target", "ref").alias("id"))
    else:
        met = types.touched(shapes.where("test"), typed).select(S, F.col("pkg").alias("path"), F.col("fn").alias("name"), F.col("type").alias("id"))
    met = met.join(tests.select(S, "path", "name"), [S, "path", "name"], "left_semi")
    ids = lambda df: df.select(S, F.concat_ws(".", "path", "name").alias("id")).distinct()
    concretes = ids(kinds.where(exported("name"))).join(ifaces, [S, "id"], "left_anti")
    return Snapshots.of(
        spark,
        snapshot=modules.select(S, "module", "commit"),
        package=own.withColumn("internal", F.lit(True)).unionByName(outside.withColumn("internal", F.lit(False))).select(S, "path", P.short("path").alias("name"), "internal", F.lit(False).alias("hole"), zero),
        file=code.select(S, "path", "file").distinct(),
        symbol=both.select(S, "path", "axis", "kind", "name", "sig", zero),
        invariant=tests.select(S, "path", "name", "file", "hash", zero),
        guard=met.join(ifaces, [S, "id"], "left_semi").select(S, "path", "name", F.col("id").alias("iface")).distinct(),
        exercise=met.join(concretes, [S, "id"], "left_semi").select(S, "path", "name", F.col("id").alias("concrete")).distinct(),
        edge=witness.select(S, "src", "kind", "dst", "scope", zero).distinct(),
        witness=witness,
    )


def extract(spark: SparkSession, root: str, snapshot_id: str = "HEAD") -> Snapshots:
    from . import expressions

    module, files = module_of(spark, root), sources(spark, root)
    return snapshot(rows_of_files(files), module, snapshot_id, expressions.of_files(files, module))
