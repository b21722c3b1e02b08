"""How Go code uses its interfaces, functions and event types.

Each file is lexed on the executors into rows of a few kinds (``usage_rows``); which of them name an interface, a
function with a body or an event type is settled by joins afterwards.  Names are resolved by package and import; the
type of a variable is known where a receiver, a parameter, a declaration or a literal states it, or a called function
of the module returns it.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import written as keep
from . import types
from .golang import _LEX, _spell

USE = "file string, dir string, test boolean, fact string, a string, b string, c string, line int"
#: Keywords and marks after which an identifier before them is a name that they declare the type of.
_TYPE_BEGINS = ("*", "[", "func", "map", "chan", "interface", "struct", "...", "<-")
_KEYWORDS = frozenset("break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var".split())


class _File:
    """One pass over a file's tokens.  ``ctx`` is the position that a type name has where it stands."""

    def __init__(self, source: str):
        self.t, self.line, n = [], [], 1
        for m in _LEX.finditer(source):
            if m.lastgroup != "skip":
                self.t.append(m[0])
                self.line.append(n)
            n += m[0].count("\n")
        self.rows: list[tuple] = []
        self.fn = ""
        self.i = 0

    def emit(self, fact, a="", b="", c="", at=None):
        self.rows.append((fact, a, b, c, self.line[min(self.i if at is None else at, len(self.line) - 1)]))

    def peek(self, k=0):
        return self.t[self.i + k] if self.i + k < len(self.t) else ""

    def close(self, i):
        depth = 0
        for j in range(i, len(self.t)):
            x = self.t[j]
            if len(x) == 1:
                depth += (x in "([{") - (x in ")]}")
            if depth == 0:
                return j
        return len(self.t)

    def line_end(self):
        """Where the statement at hand ends: the line end outside of brackets."""
        j = self.i
        while j < len(self.t) and self.t[j] not in ("\n", ";", ")", "}"):
            j = self.close(j) + 1 if self.t[j] in ("(", "[", "{") else j + 1
        return j

    def file(self):
        self.walk(len(self.t), "type-ref", top=True)
        return self.rows

    def walk(self, end, ctx, top=False, names=False):
        """``names``: identifiers may be names that are declared (parameters, fields)."""
        switch = False
        while self.i < end:
            x = self.peek()
            if x == "func":
                self.func(ctx, top)
            elif x == "import" and top:
                self.i = self.close(self.i + 1) + 1 if self.peek(1) == "(" else self.line_end()
            elif x in ("var", "const", "type") and (self.i == 0 or self.t[self.i - 1] in ("\n", "{", ";", "}")):
                self.specs(x, end)
            elif x == "struct" and self.peek(1) == "{":
                self.struct()
            elif x == "interface" and self.peek(1) == "{":
                self.interface()
            elif x == "." and self.peek(1) == "(":
                if self.peek(2) == "type":
                    switch, self.i = True, self.i + 4
                else:
                    stop = self.close(self.i + 1)
                    self.i += 2
                    self.walk(stop, "assertion")
                    self.i = stop + 1
            elif x == "{":
                stop = self.close(self.i)
                inner, switch = "type-switch" if switch else ctx, False
                self.i += 1
                self.walk(stop, inner)
                self.i = stop + 1
            elif x.isidentifier() and x not in _KEYWORDS:
                self.ident(ctx, names)
            else:
                self.i += 1

    def ident(self, ctx, names):
        x, i = self.peek(), self.i
        if i and self.t[i - 1] == ".":
            self.i += 1
            return
        nxt, after = self.peek(1), self.peek(2)
        if names and (nxt in _TYPE_BEGINS or nxt.isidentifier() or (nxt == "(" and ctx == "field")):
            self.i += 1  # a name, its type follows
            self.typed(x)
            return
        label = nxt == ":" and not (ctx == "type-switch" and self.in_case(i))
        if nxt == "." and after.isidentifier() and after not in _KEYWORDS:
            self.emit("ref", x, after, ctx)
            if self.peek(3) == "(":
                self.emit("calls", x, after, self.fn)
            if self.peek(3) == "{":
                self.emit("makes", x, after, self.fn)
            self.i += 3
            return
        if not label:
            self.emit("ref", "", x, ctx)
        if nxt == "(":
            self.emit("calls", "", x, self.fn)
        if nxt == "{":
            self.emit("makes", "", x, self.fn)
        if nxt == ":" and after == "=" or nxt == ":=":
            self.bound(x)
        self.i += 1

    def in_case(self, i):
        while i >= 0 and self.t[i] not in ("\n", "{", ";"):
            if self.t[i] == "case":
                return True
            i -= 1
        return False

    def typed(self, name):
        """A declared variable: the type's last words, at the cursor."""
        j = self.i
        while j < len(self.t) and self.t[j] in ("*", "..."):
            j += 1
        if j < len(self.t) and self.t[j].isidentifier() and self.t[j] not in _KEYWORDS:
            q = self.t[j + 1 : j + 3]
            self.emit("vtype", name, f"{self.t[j]}.{q[1]}" if len(q) == 2 and q[0] == "." and q[1].isidentifier() else self.t[j], self.fn)

    def bound(self, name):
        """``name := &T{...}``, ``T{...}``, ``pkg.T{...}`` or ``F(...)``."""
        j = self.i + 2
        while j < len(self.t) and self.t[j] == "&":
            j += 1
        if j < len(self.t) and self.t[j].isidentifier() and self.t[j] not in _KEYWORDS:
            q, k = self.t[j], j + 1
            if self.t[k : k + 1] == ["."] and k + 1 < len(self.t) and self.t[k + 1].isidentifier():
                q, k = f"{q}.{self.t[k + 1]}", k + 2
            if self.t[k : k + 1] == ["{"]:
                self.emit("vtype", name, q, self.fn)
            elif self.t[k : k + 1] == ["("]:
                self.emit("vcall", name, q, self.fn)

    def signature(self, params="param"):
        """``[types](parameters) results``, up to the body or the line's end; the first result's type."""
        if self.peek() == "[":
            self.inside(params)
        if self.peek() == "(":
            self.inside(params, names=True)
        first = ""
        if self.peek() == "(":
            begin = self.i + 1
            self.inside("result", names=True)
            first = _spell(self.t[begin : self.i - 1]).split(",")[0]
        else:
            begin = self.i
            while self.i < len(self.t) and self.peek() not in ("{", "\n", ",", ")", ";", "]", "}", ":", "="):
                if self.peek() in ("interface", "struct") and self.peek(1) == "{":
                    self.walk(self.i + 1, "result")
                elif self.peek() == "func":
                    self.func("result", False)
                elif self.peek() in ("(", "["):
                    self.inside("result")
                elif self.peek().isidentifier() and self.peek() not in _KEYWORDS:
                    self.ident("result", False)
                else:
                    self.i += 1
            first = _spell(self.t[begin : self.i])
        return first.split(" ")[-1].lstrip("*")

    def inside(self, ctx, names=False):
        stop = self.close(self.i)
        self.i += 1
        self.walk(stop, ctx, names=names)
        self.i = stop + 1

    def func(self, ctx, top):
        self.i += 1
        outer, declared = self.fn, top and (self.peek() == "(" or self.peek().isidentifier())
        begin = self.line[min(self.i, len(self.line) - 1)]
        if declared:
            receiver, variable = "", ""
            if self.peek() == "(":
                stop = self.close(self.i)
                own = [x for x in self.t[self.i : stop] if x.isidentifier()]
                receiver = next((x for x in own[1:] if x[:1].isupper() or len(own) > 1), own[0] if own else "")
                variable = own[0] if len(own) > 1 else ""
                self.i = stop + 1
            self.fn = f"{receiver}.{self.peek()}" if receiver else self.peek()
            name = self.peek()
            self.i += 1
            if variable:
                self.emit("vtype", variable, receiver, self.fn)
            at = self.i
            first = self.signature()
            body = self.peek() == "{"
            if body:
                last = self.line[min(self.close(self.i), len(self.line) - 1)]
                self.rows.append(("body", name, receiver, f"{begin}:{last}", begin))
                self.rows.append(("returns", self.fn, first, "", begin))
            if name == "Execute" and receiver and self.t[at : at + 1] == ["("]:
                own = self.t[at + 1 : self.close(at)]
                if "*" in own and "," not in own:
                    self.rows.append(("execute", receiver, own[-1], self.fn, begin))
        else:
            self.signature()
        if self.peek() == "{":
            stop = self.close(self.i)
            self.i += 1
            self.walk(stop, "type-ref" if declared else ctx)
            self.i = stop + 1
        self.fn = outer

    def specs(self, word, end):
        self.i += 1
        if self.peek() == "(":
            stop = self.close(self.i)
            self.i += 1
            while self.i < stop:
                if self.peek() in ("\n", ";"):
                    self.i += 1
                else:
                    self.spec(word)
            self.i = stop + 1
        elif self.i < end:
            self.spec(word)

    def spec(self, word):
        stop = self.line_end()
        if word == "type":
            self.emit("type", self.peek())
            self.i += 1
            if self.peek() == "[" and self.peek(1).isidentifier() and self.peek(2) not in ("]",):
                self.inside("field", names=True)
            kind = self.peek()
            if kind == "interface" and self.rows[-1][0] == "type":
                self.rows[-1] = ("interface", *self.rows[-1][1:])
                self.interface(self.rows[-1][1])
            self.walk(stop, "alias")
        else:
            own = [self.peek()]
            while self.peek(1) == "," and self.peek(2).isidentifier():
                self.i += 2
                own.append(self.peek())
            self.i += 1
            for n in own:
                self.typed(n)
            self.walk(stop, "conformance" if all(n == "_" for n in own) else "var")
        self.i = max(self.i, stop)

    def struct(self):
        stop = self.close(self.i + 1)
        self.i += 2
        self.walk(stop, "field", names=True)
        self.i = stop + 1

    def interface(self, name=""):
        stop = self.close(self.i + 1)
        self.i += 2
        while self.i < stop:
            if self.peek().isidentifier() and self.peek(1) == "(":
                method, begin = self.peek(), self.i + 1
                self.i += 1
                self.signature()
                if name:
                    self.emit("imethod", name, method, _spell(self.t[begin : self.i]))
            elif self.peek().isidentifier():
                self.emit("embeds", name, self.peek() if self.peek(1) != "." else f"{self.peek()}.{self.peek(2)}")
                self.i += 3 if self.peek(1) == "." else 1
            else:
                self.i += 1
        self.i = stop + 1


def usage_rows(source: str) -> list[tuple]:
    """(fact, a, b, c, line) of one file: ref(alias, name, position), calls(alias, name, in function),
    makes(alias, type, in function), vtype(variable, type, in function), vcall(variable, callee, in function),
    body(function, receiver, lines), returns(function, type), execute(receiver, engine, function), type(name),
    interface(name), imethod(interface, name, signature), embeds(interface, name)."""
    return _File(source).file()


def scan(spark: SparkSession, root: str) -> DataFrame:
    """Usage rows of all Go files under a folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.go").option("recursiveFileLookup", True).load(root)
    return rows_of_files(files.select("path", "content"), re.sub(r"^file:/+", "/", root.rstrip("/")))


def rows_of_files(files: DataFrame, base: str = "") -> DataFrame:
    """Usage rows of files(path, content); ``base`` is what paths begin with."""

    def run(frames):
        import pandas as pd

        for pdf in frames:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                own = re.sub(r"^file:/+", "/", path).removeprefix(base).lstrip("/")
                folder, _, name = own.rpartition("/")
                rows += [(name, folder, name.endswith("_test.go"), *f) for f in usage_rows(bytes(content).decode("utf-8", "replace"))]
            yield pd.DataFrame(rows, columns=["file", "dir", "test", "fact", "a", "b", "c", "line"])

    return files.mapInPandas(run, USE)


def _packages(rows: DataFrame, module: str) -> DataFrame:
    return rows.where("not test").withColumn("pkg", F.when(F.col("dir") == "", F.lit(module)).otherwise(F.concat_ws("/", F.lit(module), "dir")))


def _resolved(rows: DataFrame, imports: DataFrame) -> DataFrame:
    """rows(pkg, file, alias, ...) with the package that the alias stands for; no alias is the file's own."""
    named = rows.join(imports, ["pkg", "file", "alias"], "left")
    return named.withColumn("target", F.when(F.col("alias") == "", F.col("pkg")).otherwise(F.col("target"))).where("target is not null")


def _imports(facts: DataFrame, module: str) -> DataFrame:
    """(pkg, file, alias, target) of ``golang.scan`` rows."""
    return _packages(facts, module).where("fact = 'import'").select("pkg", "file", F.col("b").alias("alias"), F.col("a").alias("target"))


def interface_usage(usage: DataFrame, facts: DataFrame, implements: DataFrame, module: str) -> DataFrame:
    """A row for each declared interface with methods: fq, pkg, name, methods, implementers, consumers (array of struct pkg,
    kind, pos), consumer_pkgs, n_consumers, conformance_assertions, consumed_cross_package, candidate_unconsumed.

    implements(iface, impl) has the ids ``package.Name``, as ``delta.implementers`` gives them.  Paths are relative to the
    module.  An assertion of conformance and an embedding interface are no consumers."""
    u = _packages(usage, module)
    short = lambda c: F.when(F.col(c) == module, "(root)").when(F.startswith(c, F.lit(module + "/")), F.substr(c, F.lit(len(module) + 2))).otherwise(F.col(c))
    methods = u.where("fact = 'imethod'").groupBy("pkg", F.col("a").alias("name")).agg(F.array_sort(F.collect_set(F.concat("b", "c"))).alias("methods"))
    refs = u.where("fact = 'ref'").select("pkg", "file", F.col("a").alias("alias"), F.col("b").alias("name"), F.col("c").alias("kind"), "line")
    found = _resolved(refs, _imports(facts, module)).join(methods.select(F.col("pkg").alias("target"), "name"), ["target", "name"], "left_semi").where("kind <> 'iface-embed'")
    uses = found.groupBy(F.col("target").alias("pkg"), "name").agg(
        F.count_if(F.col("kind") == "conformance").alias("conformance_assertions"),
        F.array_sort(F.collect_list(F.when(F.col("kind") != "conformance", F.struct(F.concat_ws(":", "file", "line").alias("pos"), "kind", short("pkg").alias("pkg"))))).alias("consumers"),
        F.array_sort(F.collect_set(F.when(F.col("kind") != "conformance", short("pkg")))).alias("consumer_pkgs"),
        F.coalesce(F.bool_or(F.when(F.col("kind") != "conformance", F.col("target") != F.col("pkg"))), F.lit(False)).alias("consumed_cross_package"),
    )
    ids = implements.withColumn("pkg", F.regexp_replace("iface", r"\.[^.]*$", "")).withColumn("name", F.substring_index("iface", ".", -1))
    impls = ids.groupBy("pkg", "name").agg(F.array_sort(F.collect_set(F.when(F.startswith("impl", F.lit(module + "/")), F.substr("impl", F.lit(len(module) + 2))).otherwise(F.col("impl")))).alias("implementers"))
    none = F.array().cast("array<string>")
    out = methods.join(impls, ["pkg", "name"], "left").join(uses, ["pkg", "name"], "left")
    out = out.select(F.concat_ws(".", short("pkg"), "name").alias("fq"), short("pkg").alias("pkg"), "name", "methods", F.coalesce("implementers", none).alias("implementers"), F.coalesce("consumers", F.array().cast("array<struct<pos: string, kind: string, pkg: string>>")).alias("consumers"), F.coalesce("consumer_pkgs", none).alias("consumer_pkgs"), F.coalesce("conformance_assertions", F.lit(0)).alias("conformance_assertions"), F.coalesce("consumed_cross_package", F.lit(False)).alias("consumed_cross_package"))
    return out.withColumn("n_consumers", F.size("consumers")).withColumn("candidate_unconsumed", (F.size("implementers") <= 1) & (F.size("consumers") == 0))


def call_graph(usage: DataFrame, facts: DataFrame, module: str, snapshot_id: str = "HEAD", shapes: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """functions(snapshot_id, path, file, lo, hi) and calls(snapshot_id, src, dst): direct calls of functions and methods
    whose bodies are in the module, inside a package and across; ``path`` is ``package.Function`` or ``package.Type.Method``.

    With ``shapes`` (``expressions.of_files``) callees are resolved by the types of expressions: on fields, results, elements,
    chains and embedded types; without, where a variable's type is stated."""
    u, imports, sid = _packages(usage, module), _imports(facts, module), F.lit(snapshot_id).alias("snapshot_id")
    body = u.where("fact = 'body'")
    path = F.concat_ws(".", "pkg", F.when(F.col("b") == "", F.col("a")).otherwise(F.concat_ws(".", "b", "a")))
    span = F.split("c", ":")
    fn = body.select(sid, path.alias("path"), "file", span[0].cast("int").alias("lo"), span[1].cast("int").alias("hi"))
    if shapes is not None:
        shapes = keep(shapes.where("not test").select(sid, "*"))
        flat, _ = types.interface_methods(shapes)
        told = types.references(shapes, types.propagate(shapes, types.members(shapes, keep(flat), types.selected(shapes)))).where("called and fn <> ''")
        every = told.select("snapshot_id", F.concat_ws(".", "pkg", "fn").alias("src"), F.concat_ws(".", "target", F.when(F.col("recv") != "", F.col("recv")), "name").alias("dst")).distinct()
        return fn, _between(every, fn)
    calls = u.where("fact = 'calls' and c <> ''").select("pkg", "file", F.col("a").alias("alias"), F.col("b").alias("name"), F.col("c").alias("fn"))
    caller = F.concat_ws(".", "pkg", "fn").alias("src")
    plain = _resolved(calls, imports).select(caller, F.concat_ws(".", "target", "name").alias("dst"))
    # Methods of variables: where their type is stated, or is what a function of the module returns.
    stated = u.where("fact = 'vtype'").select("pkg", "file", F.col("a").alias("var"), F.col("b").alias("type"), F.col("c").alias("fn"))
    made = u.where("fact = 'vcall'").select("pkg", "file", F.col("a").alias("var"), F.col("b").alias("callee"), F.col("c").alias("fn"))
    cut = lambda c: (F.when(F.contains(c, F.lit(".")), F.substring_index(c, ".", 1)).otherwise(""), F.substring_index(c, ".", -1))
    known = _resolved(stated.select("pkg", "file", "var", "fn", cut("type")[0].alias("alias"), cut("type")[1].alias("name")), imports).select("pkg", "file", "var", "fn", F.concat_ws(".", "target", "name").alias("type"))
    returns = u.where("fact = 'returns' and b <> ''").select(F.col("pkg").alias("home"), F.concat_ws(".", "pkg", "a").alias("callee"), F.col("b").alias("result"))
    called = _resolved(made.select("pkg", "file", "var", "fn", cut("callee")[0].alias("alias"), cut("callee")[1].alias("name")), imports).withColumn("callee", F.concat_ws(".", "target", "name")).join(returns, "callee")
    # A result type of another package would need that file's imports; types of the function's own package are resolved.
    known = known.unionByName(called.where(~F.contains("result", F.lit("."))).select("pkg", "file", "var", "fn", F.concat_ws(".", "home", "result").alias("type"))).distinct()
    on = calls.where("alias <> ''").withColumnRenamed("alias", "var").join(known, ["pkg", "file", "var", "fn"])
    methods = on.select(caller, F.concat_ws(".", "type", "name").alias("dst"))
    return fn, _between(plain.unionByName(methods).distinct().select(sid, "src", "dst"), fn)


def _between(calls: DataFrame, functions: DataFrame) -> DataFrame:
    """Calls whose ends both have a body."""
    for end in ("src", "dst"):
        calls = calls.join(functions.select("snapshot_id", F.col("path").alias(end)), ["snapshot_id", end], "left_semi")
    return calls.select("snapshot_id", "src", "dst")


def events(usage: DataFrame, facts: DataFrame, module: str, snapshot_id: str = "HEAD") -> tuple[DataFrame, DataFrame, DataFrame]:
    """executes(snapshot_id, event, fn), constructs(snapshot_id, fn, event) and engines(event, engine): event types have a
    method ``Execute`` with a pointer as its only parameter; a function constructs what it writes as a literal or passes on."""
    u, imports, sid = _packages(usage, module), _imports(facts, module), F.lit(snapshot_id).alias("snapshot_id")
    types = u.where("fact = 'execute'").select(F.concat_ws(".", "pkg", "a").alias("event"), F.concat_ws(".", "pkg", "c").alias("fn"), F.col("b").alias("engine"))
    made = u.where("fact = 'makes' and c <> ''").select("pkg", "file", F.col("a").alias("alias"), F.col("b").alias("name"), F.col("c").alias("fn"))
    made = _resolved(made, imports).select(sid, F.concat_ws(".", "pkg", "fn").alias("fn"), F.concat_ws(".", "target", "name").alias("event")).distinct()
    return types.select(sid, "event", "fn").distinct(), made.join(types.select("event").distinct(), "event", "left_semi").select("snapshot_id", "fn", "event"), types.select("event", "engine").distinct()
