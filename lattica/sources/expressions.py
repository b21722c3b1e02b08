"""What Go sources say about types, as rows: declarations, and an edge for each step of an expression.

A file is read on the executors into constraints between nodes; nothing is resolved here.  A node is an
expression (its number in the file), a variable of a function, a package-level name, or a name of another package.  What
``a.b().c[0]`` means is left to joins (``types.propagate``): the reader only says that node 2 is ``b`` selected from
node 1, node 3 its call, and so on.

Types are spelt out with the import path of each name; ``§`` stands for the file's own package, which the content of a
file does not tell, so that rows depend on nothing else and can be kept by content.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import golang
from .golang import _close, _literal, lex

#: facts: package(name), struct(type), iface(type), named(type, underlying), alias(type, target), embed(type, embedded), field(type, name,
#: field type), imethod(interface, name, signature), iembed(interface, embedded), method(type, name, signature),
#: func(, name, signature), result(type, name, result type, position), and of bodies: seed(node, type),
#: step(from, to, operation, argument), text(node of the callee, first literal, second literal), fn(node, function).
ROWS = "fact string, a string, b string, c string, d string"
#: Rows of a batch that leaves a worker, at least, while there are files left.
_BATCH = 10_000
BASIC = frozenset("bool byte complex64 complex128 error float32 float64 int int8 int16 int32 int64 rune string uint uint8 uint16 uint32 uint64 uintptr comparable".split())
KEYWORDS = frozenset("break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var".split())
BUILTIN = frozenset("append cap clear close complex copy delete imag len make max min new panic print println real recover nil true false iota".split())


class Reader:
    def __init__(self, source: str):
        self.t = [*lex(source), *"\n\n\n\n"]
        self.rows: list[tuple] = []
        self.imports: dict[str, str] = {}
        self.fn, self.local, self.n, self.given = "", set(), 0, []

    # Types

    def name(self, x: str) -> str:
        return x if x in BASIC else "interface{}" if x == "any" else f"§.{x}"

    def type(self, i: int) -> tuple[str, int]:
        """The type that begins at i, spelt out, and where it ends; '' if none does."""
        t = self.t
        x = t[i] if i < len(t) else ""
        if x == "(":
            return self.type(i + 1)[0], _close(t, i)
        if x == "*":
            s, j = self.type(i + 1)
            return f"*{s}" if s else "", j
        if x == "...":
            s, j = self.type(i + 1)
            return f"[]{s}", j
        if x == "[":
            j = _close(t, i)
            s, k = self.type(j)
            return f"[]{s}" if s else "", k
        if x == "map" and t[i + 1] == "[":
            key, j = self.type(i + 2)[0], _close(t, i + 1)
            s, k = self.type(j)
            return f"map[{key}]{s}", k
        if x in ("chan", "<-"):
            j = i + 1
            while t[j] in ("<-", "chan"):
                j += 1
            s, k = self.type(j)
            return f"chan {s}", k
        if x == "func":
            s, results, j = self.signature(i + 1)
            return f"func{s}", j
        if x in ("struct", "interface") and t[i + 1] == "{":
            j = _close(t, i + 1)
            return f"{x}{{{' '.join(y for y in t[i + 2 : j - 1] if y != chr(10))}}}", j
        if x.isidentifier() and x not in KEYWORDS:
            j, s = i + 1, self.name(x)
            if t[j] == "." and t[j + 1].isidentifier():
                s, j = f"{self.imports.get(x, x)}.{t[j + 1]}", j + 2
            if t[j] == "[" and t[j + 1] != "]":  # of a generic type
                j = _close(t, j)
            return s, j
        return "", i

    def groups(self, lo: int, hi: int) -> list[tuple[int, int]]:
        """The comma-separated stretches of lo..hi."""
        out, begin, i = [], lo, lo
        while i < hi:
            if self.t[i] == ",":
                out.append((begin, i))
                begin = i + 1
            i = _close(self.t, i) if self.t[i] in ("(", "[", "{") else i + 1
        out.append((begin, hi))
        trimmed = []
        for a, b in out:
            while a < b and self.t[a] == "\n":
                a += 1
            while a < b and self.t[b - 1] == "\n":
                b -= 1
            if a < b:
                trimmed.append((a, b))
        return trimmed

    def parameters(self, i: int) -> tuple[list[tuple[str, str]], int]:
        """(name, type) of the list in brackets at i; names are '' where there are none."""
        end = _close(self.t, i)
        own = self.groups(i + 1, end - 1)
        starts = {a: self.type(a) for a, _ in own}
        named = any(self.t[a].isidentifier() and starts[a][1] < b and self.t[a] not in KEYWORDS for a, b in own)
        if not named:
            return [("", starts[a][0]) for a, _ in own], end
        out, last = [], ""
        for a, b in reversed(own):
            if b - a > 1:
                last = self.type(a + 1)[0]
            out.append((self.t[a], last))
        return out[::-1], end

    def signature(self, i: int) -> tuple[str, list[tuple[str, str]], int]:
        """Of ``(parameters) results``: spelt out without names, the results, and the end; parameters are kept in ``self.given``."""
        t = self.t
        if t[i] == "[":
            i = _close(t, i)
        if t[i] != "(":
            return "()", [], i
        given, j = self.parameters(i)
        results: list[tuple[str, str]] = []
        if t[j] == "(":
            results, j = self.parameters(j)
        else:
            s, k = self.type(j)
            if s:
                results, j = [("", s)], k
        self.given = given
        return f"({','.join(s for _, s in given)})({','.join(s for _, s in results)})", results, j

    # Declarations

    def file(self) -> list[tuple]:
        t, i = self.t, 0
        while i < len(t) - 4:
            x = t[i]
            if x == "package" and i + 1 < len(t):
                self.rows.append(("package", t[i + 1], "", "", ""))
                i += 2
            elif x == "import":
                end = _close(t, i + 1) if t[i + 1] == "(" else next(k for k in range(i, len(t)) if t[k] == "\n")
                for k in range(i + 1, end):
                    if t[k][0] in "\"`":
                        path = t[k][1:-1]
                        self.imports[t[k - 1] if t[k - 1] not in ("(", "\n", "import", ";") else re.sub(r"/v\d+$", "", path).rsplit("/", 1)[-1]] = path
                i = end
            elif x == "func":
                i = self.func(i + 1)
            elif x == "type":
                i = self.each(i + 1, self.declared)
            elif x in ("var", "const"):
                i = self.each(i + 1, self.variables)
            else:
                i = _close(t, i) if x in ("(", "[", "{") else i + 1
        return self.rows

    def each(self, i: int, one) -> int:
        """One specification, or those in brackets."""
        t = self.t
        if t[i] != "(":
            return one(i)
        end, j = _close(t, i), i + 1
        while j < end - 1:
            j = one(j) if t[j] not in ("\n", ";") else j + 1
        return end

    def line_end(self, i: int) -> int:
        while i < len(self.t) and self.t[i] not in ("\n", ";", ")", "}"):
            i = _close(self.t, i) if self.t[i] in ("(", "[", "{") else i + 1
        return i

    def declared(self, i: int) -> int:
        t, own = self.t, f"§.{self.t[i]}"
        j = i + 1
        if t[j] == "[" and t[j + 1].isidentifier() and t[j + 2] != "]":
            j = _close(t, j)
        if t[j] == "struct" and t[j + 1] == "{":
            self.rows.append(("struct", own, "", "", ""))
            end, k = _close(t, j + 1), j + 2
            while k < end - 1:
                stop = self.line_end(k)
                if stop > k:
                    self.field(own, k)
                k = stop + 1
            return end
        if t[j] == "interface" and t[j + 1] == "{":
            self.rows.append(("iface", own, "", "", ""))
            end, k = _close(t, j + 1), j + 2
            while k < end - 1:
                stop = self.line_end(k)
                if stop > k and t[k].isidentifier() and t[k + 1] == "(":
                    s, results, _ = self.signature(k + 1)
                    self.rows.append(("imethod", own, t[k], s, ""))
                    self.results(own, t[k], results)
                elif stop > k:
                    s, e = self.type(k)
                    self.rows.append(("iembed", own, s if e == stop else "?", "", ""))
                k = stop + 1
            return end
        alias = t[j] == "="
        s, _ = self.type(j + alias)
        self.rows.append(("alias" if alias else "named", own, s, "", ""))
        return self.line_end(i)

    def field(self, own: str, k: int) -> None:
        t = self.t
        s, e = self.type(k)
        if t[k] == "*" or e >= len(t) or t[e] in ("\n", ";", "}") or t[e][0] in "\"`":
            self.rows.append(("embed", own, s.lstrip("*"), "", ""))
            self.rows.append(("field", own, s.lstrip("*").rsplit(".", 1)[-1], s, ""))
            return
        names = [t[k]]
        while t[k + 1] == ",":
            k += 2
            names.append(t[k])
        s, _ = self.type(k + 1)
        self.rows += [("field", own, n, s, "") for n in names]

    def results(self, own: str, name: str, results: list[tuple[str, str]]) -> None:
        self.rows += [("result", own, name, s, str(k)) for k, (_, s) in enumerate(results)]

    def func(self, i: int) -> int:
        t, receiver, variable = self.t, "", ""
        if t[i] == "(":
            given, j = self.parameters(i)
            if not given:
                return j
            variable, s = given[0]
            receiver, i = s.lstrip("*"), j
        name = t[i]
        s, results, j = self.signature(i + 1)
        self.rows.append(("method" if receiver else "func", receiver, name, s, ""))
        self.results(receiver, name, results)
        if j >= len(t) or t[j] != "{":
            return j
        end = _close(t, j)
        self.fn, self.local = f"{receiver.rsplit('.', 1)[-1]}.{name}" if receiver else name, set()
        for n, kind in [(variable, f"*{receiver}"), *self.given, *results]:
            self.declare(n, kind)
        self.body(j + 1, end - 1)
        self.fn, self.local = "", set()
        return end

    # Bodies

    def declare(self, name: str, kind: str = "") -> None:
        if name and name != "_":
            if self.fn:
                self.local.add(name)
            if kind:
                self.rows.append(("seed", self.variable(name), kind, "", ""))

    def variable(self, name: str) -> str:
        return f"v:{self.fn}:{name}" if name in self.local else f"g:§.{name}"

    def step(self, source: str, op: str, arg: str = "") -> str:
        self.n += 1
        node = f"e:{self.n}"
        self.rows += [("step", source, node, op, arg), ("fn", node, self.fn, "", "")]
        return node

    def seed(self, kind: str) -> str:
        self.n += 1
        node = f"e:{self.n}"
        self.rows += [("seed", node, kind, "", ""), ("fn", node, self.fn, "", "")]
        return node

    def body(self, i: int, end: int) -> None:
        while i < end:
            i = self.statement(i, end)

    def statement(self, i: int, end: int) -> int:
        t = self.t
        if t[i] in ("var", "const"):
            return self.each(i + 1, self.variables)
        if t[i] == "type":
            return self.line_end(i)
        # Names that are bound: a, b := ... or = ..., also after if, for and switch.
        j = i + 1 if t[i] in ("if", "for", "switch", "case") else i
        header = t[i] in ("if", "for", "switch", "select")
        names, k = [], j
        while k < end and t[k].isidentifier() and t[k] not in KEYWORDS:
            names.append(t[k])
            if t[k + 1] == ",":
                k += 2
            else:
                k += 1
                break
        if names and k < end and (t[k] == ":=" or t[k] == "=" and t[k + 1] != "="):
            return self.bind(names, k + 1, end, t[k] == ":=", header)
        return self.expressions(j, end, header)

    def bind(self, names: list[str], i: int, end: int, fresh: bool, header: bool) -> int:
        t = self.t
        ranged = t[i] == "range"
        nodes: list[str] = []
        i += ranged
        while True:
            node, i = self.operand(i, end, header)
            if i < end and t[i] not in (",", "\n", ";", "{", "}", ")"):  # a sum or the like is not followed
                j = self.stop(i, end)
                self.expressions(i, j, header)
                node, i = "", j
            nodes.append(node)
            if i >= end or t[i] != "," or ranged:
                break
            i += 1
        if fresh:
            for n in names:
                self.declare(n)
        for k, n in enumerate(names):
            node = nodes[0] if len(nodes) == 1 else nodes[k] if k < len(nodes) else ""
            if not node or n == "_":
                continue
            op = ("key", "elem")[k] if ranged and k < 2 else f"pick{k}" if len(nodes) == 1 and len(names) > 1 else "copy"
            self.rows.append(("step", node, self.variable(n), op, ""))
        return i

    def stop(self, i: int, end: int) -> int:
        while i < end and self.t[i] not in (",", "\n", ";", "{", "}"):
            i = _close(self.t, i) if self.t[i] in ("(", "[") else i + 1
        return i

    def variables(self, i: int) -> int:
        t, names = self.t, [self.t[i]]
        while t[i + 1] == ",":
            i += 2
            names.append(t[i])
        s, j = self.type(i + 1) if t[i + 1] != "=" else ("", i + 1)
        for n in names:
            self.declare(n, s)
        stop = self.line_end(j)
        if t[j] == "=":
            return max(self.bind(names, j + 1, stop, False, False), stop)
        return max(stop, i + 1)

    def expressions(self, i: int, end: int, header: bool = False) -> int:
        """To the end of the statement, or to its block."""
        t = self.t
        while i < end:
            if t[i] in ("\n", ";"):
                return i + 1
            if t[i] == "{":
                j = _close(t, i)
                self.body(i + 1, min(j - 1, end))
                return j
            if t[i] in KEYWORDS and t[i] not in ("func", "map", "chan", "struct", "interface"):
                if t[i] in ("if", "for", "switch", "var", "const", "case", "type") and not header:
                    return self.statement(i, end)
                i += 1
                continue
            before = i
            _, i = self.operand(i, end, header)
            i = max(i, before + 1)
        return i

    def operand(self, i: int, end: int, header: bool = False) -> tuple[str, int]:
        """The node of the expression at i ('' if its type is not followed), and where it ends."""
        t = self.t
        received = False
        while i < end and t[i] in ("&", "*", "-", "!", "+", "^", "<-"):
            received |= t[i] == "<-"
            i += 1
        if i >= end:
            return "", i
        x, node = t[i], ""
        if x == "func":
            _, results, j = self.signature(i + 1)
            for n, kind in [*self.given, *results]:
                self.declare(n, kind)
            if j < end and t[j] == "{":
                stop = _close(t, j)
                self.body(j + 1, stop - 1)
                j = stop
            i = j
        elif x == "(":
            stop = _close(t, i)
            node, j = self.operand(i + 1, stop - 1)
            if j < stop - 1:
                self.expressions(j, stop - 1)
                node = ""
            i = stop
        elif x in ("[", "map", "chan", "struct", "interface"):
            s, j = self.type(i)
            if s and j < end and t[j] in ("{", "("):
                node, i = self.seed(s), _close(t, j)
                self.inside(j, i)
            else:
                i = max(j, i + 1)
        elif x.isidentifier() and x not in KEYWORDS:
            node, i = self.named(i, end, header)
        else:
            return "", i + 1
        return self.chain(node, i, end, header, received)

    def named(self, i: int, end: int, header: bool) -> tuple[str, int]:
        t, x = self.t, self.t[i]
        if x in BUILTIN and x not in self.local:
            if x in ("make", "new") and t[i + 1] == "(":
                stop = _close(t, i + 1)
                s, j = self.type(i + 2)
                self.expressions(j, stop - 1)
                return self.seed(s), stop
            if x == "append" and t[i + 1] == "(":
                stop = _close(t, i + 1)
                node, j = self.operand(i + 2, stop - 1)
                self.expressions(j, stop - 1)
                return node, stop
            return "", i + 1
        qualified = x in self.imports and x not in self.local and t[i + 1] == "." and t[i + 2].isidentifier()
        spelt, j = (f"{self.imports[x]}.{t[i + 2]}", i + 3) if qualified else (self.name(x), i + 1)
        last = t[j - 1]
        if j < end and t[j] == "{" and not (header and last[:1].islower()) and x not in self.local and not header:
            stop = _close(t, j)
            node = self.seed(spelt)
            self.inside(j, stop)
            return node, stop
        if t[j] == ":" and t[j + 1] != "=":  # a key or a label
            return "", j + 1
        if x in BASIC and x not in self.local:
            return "", j
        return self.step(f"g:{spelt}" if qualified else self.variable(x), "copy"), j

    def inside(self, i: int, stop: int) -> None:
        """Expressions between brackets."""
        for a, b in self.groups(i + 1, stop - 1):
            while a < b:
                before = a
                _, a = self.operand(a, b)
                a = max(a, before + 1)

    def chain(self, node: str, i: int, end: int, header: bool, received: bool) -> tuple[str, int]:
        t = self.t
        while i < end:
            if t[i] == "." and i + 1 < len(t) and t[i + 1] == "(":
                s, stop = ("", _close(t, i + 1)) if t[i + 2] == "type" else (self.type(i + 2)[0], _close(t, i + 1))
                node, i = (self.seed(s) if s else node), stop
            elif t[i] == "." and t[i + 1].isidentifier():
                node = self.step(node, "sel", t[i + 1]) if node else ""
                i += 2
            elif t[i] == "(":
                stop = _close(t, i)
                own = self.groups(i + 1, stop - 1)
                texts = [_literal("\0".join(t[a:b])) for a, b in own[:2]] + ["", ""]
                self.inside(i, stop)
                if node:
                    if texts[0] or texts[1]:
                        self.rows.append(("text", node, texts[0], texts[1], ""))
                    node = self.step(node, "call")
                i = stop
            elif t[i] == "[":
                stop = _close(t, i)
                sliced = any(t[a] == ":" for a in range(i + 1, stop - 1))
                self.inside(i, stop)
                node = node and (node if sliced else self.step(node, "index"))
                i = stop
            else:
                break
        if received and node:
            node = self.step(node, "elem")
        return node, i


def expression_rows(source: str) -> list[tuple]:
    """The rows of one file.  Of a file that breaks off, or nests beyond all measure, those of the part before."""
    reader = Reader(source)
    try:
        return reader.file()
    except (IndexError, RecursionError):
        return reader.rows


def of_contents(contents: DataFrame, outer: bool = False) -> DataFrame:
    """Rows of contents(key, content): key, and what the content says; with ``outer``, also ``_test`` where the package is named so."""
    names = ["key", "fact", "a", "b", "c", "d", *(["outer"] if outer else [])]

    def run(batches):
        import pyarrow as pa

        for b in batches:
            rows = []
            for key, content in zip(b.column("key").to_pylist(), b.column("content").to_pylist(), strict=True):
                own = expression_rows(content.decode("utf-8", "replace"))
                tail = ("_test" if any(r[0] == "package" and r[1].endswith("_test") for r in own) else None,) if outer else ()
                rows += [(key, *r, *tail) for r in own]
                if len(rows) > _BATCH:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in zip(*rows, strict=True)], names=names)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in zip(*rows, strict=True)], names=names)

    return contents.select(F.col("key").cast("string"), "content").mapInArrow(run, f"key string, {ROWS}" + (", outer string" if outer else ""))


def of_files(files: DataFrame, module: str) -> DataFrame:
    """Rows of files(path, content) of one module, in their packages (``types.placed`` without a snapshot).  A file is told by its
    path and read once: nothing is joined."""
    from . import types

    m, rows = F.lit(module), of_contents(files.select(F.ltrim("path", F.lit("/")).alias("key"), "content"), outer=True)
    own = golang.placed_files(F.col("key"))
    at = rows.select("*", *[c.alias(n) for n, c in own.items()])
    return types.put_in(at.select(F.lit("").alias("snapshot_id"), golang.package_path(m, F.col("dir")).alias("pkg"), "file", "test", "outer", "fact", *"abcd")).drop("snapshot_id")
