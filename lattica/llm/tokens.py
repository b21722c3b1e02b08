"""Exact, memoised encoding with the ``tokenizers`` library.

Both public vocabularies split a text before they merge: at white space, between letters, digits and
marks.  A block of texts is cut at such places with numpy, Arrow finds the distinct pieces, each piece that
a worker has not met is encoded by the library, and Arrow lines the remembered ids up again.  Pieces that
the vocabulary would not split further (runs of letters, most of what is new in a large corpus) go straight
to the library's merge model; all others go through the whole tokenizer.

Where a cut could change the result (an ASCII blank beside a Unicode one, control characters that Python and
Unicode class differently, an added token's string), or a vocabulary splits in some other way, whole texts
are given to the library.  Tests compare with whole-text encoding.
"""

from __future__ import annotations

import json
import os
import re
import sys
from itertools import compress

if sys.byteorder != "little":
    raise ImportError("ids are kept as little-endian 32-bit numbers")
#: Bytes of text that are cut at once; longer texts are taken apart first.
BLOCK = 4 << 20
#: Bytes that a worker remembers at most, about; beyond half of it only what was met since is kept.
MEMO_BYTES = 96 << 20
_PER_ENTRY = 190
#: Where a long text may be taken apart: a blank after a visible ASCII character.
_BREAK = re.compile(rb"(?<=[!-~])[ \t\n]")
_LETTERS = re.compile(rb" ?(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")
_MARKS = re.compile(rb"[\xcc\xcd][\x80-\xbf]")
_ODD = re.compile(rb"[\x1c-\x1f]")
_UNICODE_BLANK = rb"(?:\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80)"
_MIXED_BLANKS = re.compile(rb"[\t-\r ]" + _UNICODE_BLANK + rb"|" + _UNICODE_BLANK + rb"[\t-\r ]")


def _classes():
    """Of each byte: 0 other, 1 white space, 2 ASCII letter, 3 digit, 4 ASCII mark, 5 apostrophe."""
    import numpy as np

    c = np.zeros(256, np.uint8)
    c[[9, 10, 11, 12, 13, 32]] = 1
    for a, b, k in ((33, 47, 4), (48, 57, 3), (58, 64, 4), (65, 90, 2), (91, 96, 4), (97, 122, 2), (123, 126, 4), (39, 39, 5)):
        c[a : b + 1] = k
    return c


def _visible():
    """Byte -> the character that byte-level vocabularies write it as, but for the line feed, which parts words here."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {b: chr(b) for b in own}
    for i, b in enumerate(x for x in range(256) if x not in table):
        table[b] = chr(256 + i)
    del table[10]
    return table


class _Memo:
    """piece -> ids as bytes, in two generations: when the younger is full, the elder is forgotten."""

    def __init__(self, limit: int):
        self.young, self.old, self.size, self.limit = {}, {}, 0, limit // 2

    def ids(self, pieces: list[bytes], learn) -> list[bytes]:
        young, old = self.young, self.old
        found = list(map(young.get, pieces))
        if None not in found:
            return found
        missing = list(compress(pieces, [x is None for x in found]))
        known = list(map(old.get, missing))
        todo = list(compress(missing, [x is None for x in known])) if old else missing
        learnt = iter(learn(todo))
        new = [next(learnt) if x is None else x for x in known]
        young.update(zip(missing, new, strict=True))
        self.size += _PER_ENTRY * len(new) + sum(map(len, missing)) + sum(map(len, new))
        if self.size > self.limit:
            self.young, self.old, self.size = {}, young, 0
        it = iter(new)
        return [next(it) if x is None else x for x in found]


class Encoder:
    """Text to ids, as little-endian unsigned 32-bit bytes; equal to the library's
    ``encode(text, add_special_tokens=False).ids``."""

    def __init__(self, path: str, memo_bytes: int = MEMO_BYTES, block: int = BLOCK):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        self.model = Tokenizer(self.tokenizer.model)
        self.added = [x["content"].encode() for x in spec.get("added_tokens") or []]
        self.kind = _kind(spec)
        self.memo, self.block = _Memo(memo_bytes), block
        self.classes, self.visible = _classes(), _visible()
        import numpy as np

        self.suspect = np.zeros(256, bool)  # bytes of odd characters, and first bytes of blanks beyond ASCII
        self.suspect[[0x1C, 0x1D, 0x1E, 0x1F, 0xC2, 0xE1, 0xE2, 0xE3]] = True
        self.lower = np.arange(256, dtype=np.uint8)
        self.lower[65:91] += 32
        vocab, end = self.tokenizer.get_vocab(with_added_tokens=False), spec["model"].get("end_of_word_suffix") or ""
        self.lengths = np.zeros(max(vocab.values(), default=0) + 1, np.int64)
        self.lengths[list(vocab.values())] = [len(x.removesuffix(end)) for x in vocab]

    def _library(self, texts: list[str]) -> list[bytes]:
        import numpy as np

        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of new pieces: one call of the merge model for runs of letters, one of the tokenizer for the rest."""
        import numpy as np

        plain = [p.lstrip(b" ").isalpha() or _LETTERS.fullmatch(p) is not None for p in pieces]
        words = b"\n".join(compress(pieces, plain))
        if self.kind == "words":
            words = words.replace(b" ", b"").decode().lower().encode()
        words = words.decode("latin-1").translate(self.visible).split("\n") if words else []
        rest = iter(self._library([p.decode("utf-8", "surrogatepass") for p, x in zip(pieces, plain, strict=True) if not x]))
        if not words:
            return list(rest)
        ids = np.array(self.model.encode_batch_fast([words], is_pretokenized=True, add_special_tokens=False)[0].ids, "<u4")
        # Tokens spell the words out, so their lengths tell where each word ends.
        spelt, lengths = np.cumsum(self.lengths[ids]), np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
        ends = np.searchsorted(spelt, lengths)
        if not np.array_equal(spelt[ends], lengths):
            raise ValueError("ids that do not spell their words")
        raw, ends = ids.tobytes(), (4 * ends + 4).tolist()
        own = iter([raw[a:b] for a, b in zip([0, *ends], ends)])
        return [next(own) if x else next(rest) for x in plain]

    def _cuts(self, data, starts):
        """Where the pieces of a block begin; ``starts``: where its texts begin."""
        import numpy as np

        c = self.classes[data]
        before, here = c[:-1], c[1:]
        blank, was = here == 1, before == 1
        cut = np.empty(len(data), bool)
        cut[0] = True
        # A run of white space begins a piece, and so does its last character, to which a word is joined if it is a space.
        cut[1:] = blank & ~was
        last = np.zeros(len(data), bool)
        last[:-1] = (c[:-1] == 1) & (c[1:] != 1)
        ends = starts[1:-1] - 1  # a run at a text's end stays whole
        last[ends[ends >= 0]] = False
        if len(data):
            last[-1] = False
        cut |= last
        after = was & ~blank & (data[:-1] != 32)
        # Letters, digits and marks part, except where an apostrophe could begin a contraction.
        letter = before == 2
        wide = np.zeros(len(before), bool)
        wide[1:] = (data[:-2] == 0xC3) & (data[1:-1] >= 0x80) & (data[1:-1] <= 0xBF) & (data[1:-1] != 0x97) & (data[1:-1] != 0xB7)
        mark = here >= 4
        after |= (letter | wide) & ((here == 3) | mark)
        after |= (before == 3) & ((here == 2) | mark)
        after |= (before >= 4) & (here == 3)
        after |= (before == 4) & (here == 2)
        cut[1:] |= after
        cut[starts[:-1][starts[:-1] < len(data)]] = True
        return np.flatnonzero(cut)

    def _block(self, texts: list[bytes]):
        """(ids of all texts as one buffer, where each text's begin, in bytes) of texts that may be cut."""
        import numpy as np
        import pyarrow as pa

        raw = b"".join(texts)
        starts = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(t) for t in texts], out=starts[1:])
        if not raw:
            return b"", starts
        data = np.frombuffer(raw, np.uint8)
        if self.kind == "words" and not _MARKS.search(raw):
            # In lower case, as the vocabulary has it; not where a mark could join a letter before that.
            data = self.lower[data]
        cuts = self._cuts(data, starts)
        offsets = np.append(cuts, len(data)).astype(np.int32)
        pieces = pa.Array.from_buffers(pa.binary(), len(cuts), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
        coded = pieces.dictionary_encode()
        _, ends, spelt = coded.dictionary.buffers()
        ends, spelt = np.frombuffer(ends, np.int32)[: len(coded.dictionary) + 1].tolist(), spelt.to_pybytes()
        known = pa.array(self.memo.ids([spelt[a:b] for a, b in zip(ends, ends[1:])], self._learn), pa.large_binary())
        ids = known.take(coded.indices)
        at = np.frombuffer(ids.buffers()[1], np.int64)[: len(ids) + 1]
        return ids.buffers()[2] or b"", at[np.searchsorted(cuts, starts)]

    def _whole(self, text: bytes) -> bool:
        return not self.kind or bool(_ODD.search(text)) or any(a in text for a in self.added) or (self.kind == "bytes" and bool(_MIXED_BLANKS.search(text)))

    def encode(self, texts: list[str]) -> list[bytes]:
        import numpy as np

        raws = [t.encode("utf-8", "surrogatepass") for t in texts]
        all_ = b"\n".join(raws)
        suspect = not self.kind or self.suspect[np.frombuffer(all_, np.uint8)].any() or any(a in all_ for a in self.added)
        del all_
        out: list = [None] * len(texts)
        todo: list[tuple[int, bytes]] = []
        for i, raw in enumerate(raws):
            if suspect and self._whole(raw):
                out[i] = self._library([texts[i]])[0]
            else:
                todo += [(i, p) for p in _parts(raw, self.block)]
        at = 0
        while at < len(todo):
            to, size = at, 0
            while to < len(todo) and (to == at or size + len(todo[to][1]) <= self.block):
                size += len(todo[to][1])
                to += 1
            ids, starts = self._block([p for _, p in todo[at:to]])
            view, starts = memoryview(ids), starts.tolist()
            for (i, _), a, b in zip(todo[at:to], starts, starts[1:]):
                out[i] = bytes(view[a:b]) if out[i] is None else out[i] + bytes(view[a:b])
            at = to
        return out


def _parts(raw: bytes, size: int) -> list[bytes]:
    """A text in parts of ``size`` bytes or little more, taken apart where that changes nothing."""
    if len(raw) <= size:
        return [raw]
    out, at = [], 0
    while len(raw) - at > size and (m := _BREAK.search(raw, at + size)):
        out.append(raw[at : m.start()])
        at = m.start()
    return [*out, raw[at:]]


def _kind(spec: dict) -> str:
    """How the vocabulary splits: ``bytes`` keeps white space before a word, ``words`` drops it."""
    pre, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
    if norm is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space"):
        return "bytes"
    steps = [x.get("type") for x in (norm or {}).get("normalizers", [])]
    split = (pre.get("pretokenizers") or [{}])[0]
    if steps == ["NFC", "Replace", "Lowercase"] and split.get("type") == "Split" and split.get("invert") and split.get("behavior") == "Removed":
        return "words"
    return ""


_LOADED: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per vocabulary and Python worker."""
    if path not in _LOADED:
        _LOADED[path] = Encoder(path)
    return _LOADED[path]


def vocabulary(name: str) -> str:
    """Where a public vocabulary file lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)
