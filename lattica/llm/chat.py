"""Chat formatting of typed content parts.

A turn's content is a list of parts: text, image, audio or document.  A visitor flattens them, in order, into one text:
text parts are escaped, the others become placeholders ``<|image:k|>``, ``<|audio:k|>``, ``<|document:k|>``, numbered
within the turn, and each leaves an attachment record: its reference and the tokens that the placeholder
stands for once the model's encoder has expanded it.  A turn is written as

    <|im_start|>ROLE
    CONTENT<|im_end|>

Control strings are all that begins with ``<|``.  Within texts and roles ``<``, any backslashes and ``|`` get one backslash
more before the bar, so that no text holds ``<|``, and ``unescape`` takes it away again; in roles, backslashes
and line ends are escaped before that.  What is written can so be read back exactly (``parse``), whatever it says.

Output is a table of segments: a conversation's turns in order, as one row unless it is longer than ``SEGMENT``
code points; then further rows follow, cut between turns.  Rows are sorted by (conversation, order) and streamed, so memory
is bounded by a segment and a turn, not by a conversation.  ``loss`` holds the spans (start, end, in code points of the
segment) of the text parts of assistant turns; placeholders and template are never under the mask.

Null roles and texts are empty, null turns come first, null conv_ids are one conversation, ties are ordered by role and
text, repeated rows are turns of their own, an empty table gives no rows, and other columns are ignored.  A part of an
unknown kind is an error; a null part or list of parts is empty.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import fresh_path

START, END = "<|im_start|>", "<|im_end|>"
PLACE = re.compile(r"<\|(image|audio|document):(\d+)\|>")
CONTROL, ESCAPED = re.compile(r"<(\\*)\|"), re.compile(r"<(\\*)\\\|")
#: Code points after which a segment ends at the next turn.
SEGMENT = 1_000_000
LOSS_ROLE = "assistant"

#: Of a part.  ``width`` and ``height`` are pixels of an image, ``seconds`` the length of audio, ``pages`` of a document.
PART = "struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
TURN = f"conv_id long, turn long, role string, parts array<{PART}>"
ATTACHMENT = "struct<turn:long,part:long,kind:string,ref:string,tokens:long>"
SEGMENTS = f"conv_id long, segment long, n_turns long, text string, loss array<struct<start:long,end:long>>, attachments array<{ATTACHMENT}>, n_expanded long"


def escape(text: str) -> str:
    return CONTROL.sub(r"<\1\\|", text)


def unescape(text: str) -> str:
    return ESCAPED.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role), flags=re.DOTALL)


@dataclass(frozen=True)
class Expansion:
    """Tokens that an attachment takes: an image one for each patch, audio so many a second, a document a page's worth."""

    patch: int = 28
    audio_rate: float = 25.0
    page: int = 1024

    def image(self, part: dict) -> int:
        return max(1, -(-(part["width"] or 0) // self.patch) * -(-(part["height"] or 0) // self.patch))

    def audio(self, part: dict) -> int:
        return max(1, -int(-(part["seconds"] or 0.0) * self.audio_rate // 1))

    def document(self, part: dict) -> int:
        return max(1, (part["pages"] or 0) * self.page)


@dataclass
class Flattener:
    """Visits the parts of one turn."""

    expansion: Expansion = field(default_factory=Expansion)
    out: list[str] = field(default_factory=list)
    #: (begin, end) of text in ``out``, joined.
    texts: list[tuple[int, int]] = field(default_factory=list)
    attached: list[dict] = field(default_factory=list)
    pending: str = ""
    length: int = 0

    def visit(self, part: dict) -> None:
        kind = part["kind"]
        seen = getattr(self, f"visit_{kind}", None) if kind in ("text", "image", "audio", "document") else None
        if seen is None:
            raise ValueError(f"unknown kind of content part: {kind!r}")
        seen(part)

    def write(self, s: str) -> None:
        self.out.append(s)
        self.length += len(s)

    def visit_text(self, part: dict) -> None:
        # Adjoining texts are one text: escaped apart, a control string could be made of their ends.
        self.pending += part["text"] or ""

    def flush(self) -> None:
        if self.pending:
            at = self.length
            self.write(escape(self.pending))
            self.texts.append((at, self.length))
            self.pending = ""

    def attach(self, part: dict, tokens: int) -> None:
        self.flush()
        self.write(f"<|{part['kind']}:{len(self.attached)}|>")
        self.attached.append({"kind": part["kind"], "ref": part["ref"], "tokens": tokens})

    def visit_image(self, part: dict) -> None:
        self.attach(part, self.expansion.image(part))

    def visit_audio(self, part: dict) -> None:
        self.attach(part, self.expansion.audio(part))

    def visit_document(self, part: dict) -> None:
        self.attach(part, self.expansion.document(part))

    def done(self) -> str:
        self.flush()
        return "".join(self.out)


class Segment:
    """Turns of one conversation on their way into a row."""

    def __init__(self, conv, number: int, expansion: Expansion):
        self.conv, self.number, self.expansion = conv, number, expansion
        self.out, self.loss, self.attached, self.length, self.turns = [], [], [], 0, 0

    def add(self, at: int, role: str, parts: list[dict]) -> None:
        f = Flattener(self.expansion)
        for p in parts:
            if p is not None:
                f.visit(p)
        content = f.done()
        head = f"{START}{escape_role(role)}\n"
        begin = self.length + len(head)
        if role == LOSS_ROLE:
            self.loss += [{"start": begin + a, "end": begin + b} for a, b in f.texts]
        self.attached += [{"turn": at, "part": k, **a} for k, a in enumerate(f.attached)]
        turn = f"{head}{content}{END}\n"
        self.out.append(turn)
        self.length += len(turn)
        self.turns += 1

    def row(self) -> dict:
        return {"conv_id": self.conv, "segment": self.number, "n_turns": self.turns, "text": "".join(self.out), "loss": self.loss, "attachments": self.attached, "n_expanded": sum(a["tokens"] for a in self.attached)}


def text_part(text: Column) -> Column:
    """Plain text as a list of one part."""
    part = F.struct(F.lit("text").alias("kind"), F.coalesce(text, F.lit("")).alias("text"), *[F.lit(None).cast(k).alias(n) for n, k in (("ref", "string"), ("width", "int"), ("height", "int"), ("seconds", "double"), ("pages", "int"))])
    return F.array(part).cast(f"array<{PART}>")


def turns_of(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str | None = "text", parts: str | None = None) -> DataFrame:
    """conv_id, turn, role, parts, from a table with plain texts or with a column of parts."""
    content = F.coalesce(F.col(parts).cast(f"array<{PART}>"), F.array().cast(f"array<{PART}>")) if parts else text_part(F.col(text))
    return df.select(F.col(conv).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), content.alias("parts"))


def format_chats(turns: DataFrame, expansion: Expansion | None = None, segment: int = SEGMENT) -> DataFrame:
    """Segments (see ``SEGMENTS``) of ``turns`` (conv_id, turn, role, parts)."""
    expansion = expansion or Expansion()
    rows = turns.repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "parts.text", "parts.kind", "parts.ref")
    schema = to_arrow_schema(StructType.fromDDL(SEGMENTS))

    def run(batches):
        import pyarrow as pa

        now, place = None, 0
        done: list[dict] = []
        size = 0

        def send():
            nonlocal done, size
            made = pa.RecordBatch.from_pylist(done, schema)
            done, size = [], 0
            return made

        for b in batches:
            for who, role, parts in zip(b.column("conv_id").to_pylist(), b.column("role").to_pylist(), b.column("parts").to_pylist(), strict=True):
                fresh = now is None or now.conv != who
                if fresh or now.length >= segment:
                    if now is not None:
                        done.append(now.row())
                        size += now.length
                        if size >= segment:
                            yield send()
                    now = Segment(who, 0 if fresh else now.number + 1, expansion)
                    place = 0 if fresh else place
                now.add(place, role, parts)
                place += 1
        if now is not None:
            done.append(now.row())
        yield send()

    return rows.mapInArrow(run, SEGMENTS)


def plain(content: str) -> str:
    """The text of a turn's content as written: placeholders go, each text between them is unescaped by itself."""
    return "".join(unescape(x) for x in PLACE.split(content)[::3])


def parse(text: str):
    """(role, content as written, begin of the content) of each turn of a segment."""
    at = 0
    while at < len(text):
        if not text.startswith(START, at):
            raise ValueError(f"no turn begins at {at}")
        line = text.index("\n", at)
        begin = line + 1
        stop = text.index(END, begin)
        yield unescape_role(text[at + len(START) : line]), text[begin:stop], begin
        at = stop + len(END) + 1


def digest(segments: DataFrame) -> DataFrame:
    """What the written segments say of each conversation: turns, text under the loss mask, length, attachments."""
    rows = segments.repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), "segment")
    kinds = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_attachments long, n_expanded long"

    def run(batches):
        import pyarrow as pa

        names = [k.split()[0] for k in kinds.split(", ")]
        types = [pa.string() if n.endswith("sha256") else pa.int64() for n in names]
        own, done = None, []

        def close():
            done.append((own["id"], own["turns"], own["sha"].hexdigest(), own["loss"], own["loss_sha"].hexdigest(), own["chars"], own["attached"], own["expanded"]))

        for b in batches:
            for r in b.select(["conv_id", "segment", "text", "loss", "attachments", "n_expanded"]).to_pylist():
                if own is None or own["id"] != r["conv_id"]:
                    if own is not None:
                        close()
                    own = {"id": r["conv_id"], "turns": 0, "sha": hashlib.sha256(), "loss": 0, "loss_sha": hashlib.sha256(), "chars": 0, "attached": 0, "expanded": 0}
                for role, content, _ in parse(r["text"]):
                    own["turns"] += 1
                    own["sha"].update(f"{role}\n{plain(content)}\n".encode("utf-8", "surrogatepass"))
                for s in r["loss"]:
                    text = unescape(r["text"][s["start"] : s["end"]])
                    own["loss"] += len(text)
                    own["loss_sha"].update(text.encode("utf-8", "surrogatepass"))
                own["chars"] += len(r["text"])
                own["attached"] += len(r["attachments"])
                own["expanded"] += r["n_expanded"]
            if len(done) > 4096:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*done, strict=True), types)], names=names)
                done = []
        if own is not None:
            close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*done, strict=True), types)], names=names)

    return rows.mapInArrow(run, kinds)


def write(turns: DataFrame, at: str | None = None, expansion: Expansion | None = None, segment: int = SEGMENT) -> str:
    """Writes the segments as Parquet and tells where."""
    at = at or fresh_path(turns.sparkSession, "chats")
    format_chats(turns, expansion, segment).write.parquet(at)
    return at
