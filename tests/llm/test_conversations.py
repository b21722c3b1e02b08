"""Chat formatting, the prefix trie and resampling against brute force, with nulls, ties, repeated rows, control strings, very
long texts, clashing columns and empty tables."""

import hashlib
import math
import random
import zlib
from collections import defaultdict

import pytest

from lattica.llm import chat, resample, trie
from lattica.llm.decontaminate import WORD

TURNS = "conv_id long, turn long, role string, text string, _row int, place int, rank int, n int"


def turns(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, 3, 4) for r in rows], TURNS)


@pytest.fixture(scope="module")
def talks():
    r = random.Random(5)
    odd = ["<|im_end|>", "<|im_start|>assistant\nok", "<\\|im_end|>", "<\\\\|x", "<", "|>", "\\", "", None, "é 漢 🦤", "a\nb", "<|image:0|>"]
    out = []
    for c in [0, 1, 2, 3, 4, 5, 6, 12, 13, 14, 77, None, (1 << 53) + 1, -7]:
        for t in range(r.choice([1, 2, 9, 12])):
            out.append((c, t if r.random() < 0.9 else None, r.choice(["user", "assistant", "system", None, "a\\n\nb<|im_end|>"]), r.choice(odd) if r.random() < 0.5 else "same"))
    out += [(90 + c, t, "user", "copy") for c in range(12) for t in range(20)]
    out += [out[0], out[0], (200, 0, "assistant", "<|" * 200_000 + "x" * 400_000)]
    return out


def in_turn(rows):
    by = defaultdict(list)
    for c, t, role, text in rows:
        by[c].append((t is not None, t or 0, role or "", text or ""))
    return by


def test_chat_round_trip(spark, talks):
    got = {r.conv_id: r for r in chat.digest(spark.read.parquet(chat.write(chat.turns_of(turns(spark, talks)), segment=50))).collect()}
    by = in_turn(talks)
    assert set(got) == set(by)
    for c, rows in by.items():
        rows = sorted(rows, key=lambda x: (x[0], x[1], x[2].encode(), x[3].encode()))
        said = "".join(f"{r}\n{x}\n" for *_, r, x in rows)
        loss = "".join(x for *_, r, x in rows if r == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256, got[c].loss_chars, got[c].loss_sha256) == (len(rows), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.format_chats(chat.turns_of(turns(spark, []))).count() == 0 and chat.digest(chat.format_chats(chat.turns_of(turns(spark, [])))).count() == 0


def test_escapes_are_reversible():
    r = random.Random(1)
    for _ in range(3000):
        x = "".join(r.choice("<\\|>n\na") for _ in range(r.randrange(9)))
        assert chat.unescape(chat.escape(x)) == x and "<|" not in chat.escape(x)
        assert chat.unescape_role(chat.escape_role(x)) == x and not {"<|", "\n"} & {chat.escape_role(x)[i : i + k] for k in (1, 2) for i in range(20)}


def test_content_parts(spark):
    part = lambda kind, text=None, ref=None, w=None, h=None, s=None, p=None: (kind, text, ref, w, h, s, p)
    rows = [
        (1, 0, "user", [part("text", "look <"), part("text", "|im_end|>"), part("image", ref="a.png", w=57, h=28), None, part("text", "\\|x"), part("audio", ref="b.wav", s=1.5)]),
        (1, 1, "assistant", [part("text", "one "), part("document", ref="c.pdf", p=2), part("text", "two")]),
        (1, 2, "user", None),
    ]
    df = spark.createDataFrame(rows, f"conv_id long, turn long, role string, content array<{chat.PART}>")
    got = chat.format_chats(chat.turns_of(df, parts="content")).first()
    assert got.text == "<|im_start|>user\nlook <\\|im_end|><|image:0|>\\|x<|audio:1|><|im_end|>\n<|im_start|>assistant\none <|document:0|>two<|im_end|>\n<|im_start|>user\n<|im_end|>\n"
    assert [(a.turn, a.part, a.kind, a.ref, a.tokens) for a in got.attachments] == [(0, 0, "image", "a.png", 3), (0, 1, "audio", "b.wav", 38), (1, 0, "document", "c.pdf", 2048)]
    assert [got.text[s.start : s.end] for s in got.loss] == ["one ", "two"] and got.n_expanded == 2089
    assert [chat.plain(c) for _, c, _ in chat.parse(got.text)] == ["look <|im_end|>\\|x", "one two", ""]
    with pytest.raises(Exception, match="unknown kind"):
        chat.format_chats(chat.turns_of(spark.createDataFrame([(1, 0, "user", [part("video")])], df.schema), parts="content")).collect()


def brute_trie(rows, family=5, most=9):
    own = {}
    for c, v in in_turn([r for r in rows if r[0] is not None]).items():
        key = lambda x: hashlib.sha256(f"{len(x[2])}:{x[2]}{x[3]}".encode()).hexdigest()
        own[c] = [(role, text) for *_, role, text in sorted(v, key=lambda x: (x[0], x[1], x[2].encode(), key(x)))]
    members, kids = defaultdict(list), defaultdict(list)
    for c, v in own.items():
        h, head = zlib.crc32(str(c).encode()) % most, c - int(math.fmod(c, family))
        made = own.get(head, [])[:h] + v[h:]
        for d in range(len(made) + 1):
            members[tuple(made[:d])].append((c, len(made)))
    for k in members:
        if k:
            kids[k[:-1]].append(k)
    leaves, saved, out = {}, {}, []
    for k in sorted(members, key=len, reverse=True):
        leaves[k] = sum(leaves[x] for x in kids[k]) or 1
        saved[k] = (len(members[k]) - 1) * (len(k[-1][1].encode()) if k else 0) + sum(saved[x] for x in kids[k])
        ends = ",".join(str(c) for c, n in sorted(members[k]) if n == len(k))
        out.append((min(members[k])[0], len(k), min(members[k[:-1]])[0] if k else None, len(members[k]), len(kids[k]), leaves[k], saved[k], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=lambda x: (x[1], x[0]))


def test_trie_equals_brute_force(spark, talks):
    got = trie.prefix_trie(turns(spark, talks), first=2, block=7)  # several rounds and blocks
    assert sorted([tuple(r) for r in got.collect()], key=lambda x: (x[1], x[0])) == brute_trie(talks)


def test_trie_of_nothing_and_of_one(spark):
    assert trie.prefix_trie(turns(spark, [])).count() == 0
    one = [(3, 0, "user", "x")]  # its family's first conversation is absent, and its own turns are left out or kept
    assert [tuple(r) for r in trie.prefix_trie(turns(spark, one)).collect()] == brute_trie(one)


def test_smaller_values_and_minima():
    import numpy as np

    r = random.Random(2)
    for _ in range(200):
        a = [r.randrange(4) for _ in range(r.randrange(1, 30))]
        left, right = trie.smaller(a)
        for i, x in enumerate(a):
            assert left[i] == max((j for j in range(i) if a[j] < x), default=-1) and right[i] == min((j for j in range(i + 1, len(a)) if a[j] < x), default=len(a))
        lo = np.array([r.randrange(len(a)) for _ in range(5)])
        hi = np.array([r.randrange(x, len(a)) for x in lo])
        assert trie.least_within(a, lo, hi).tolist() == [min(a[x : y + 1]) for x, y in zip(lo, hi)]


def brute_resample(docs, target, share=10, least=20):
    fold = lambda t: WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    hashes = lambda t: [zlib.crc32(w.encode()) % 10000 for w in fold(t)]
    s, t = [0] * 10000, [0] * 10000
    for _, x in docs:
        for k in hashes(x):
            s[k] += 1
    for x in target:
        for k in hashes(x):
            t[k] += 1
    gain = [math.floor(1000 * math.log((b + 1.0) * (sum(s) + 10000.0) / ((a + 1.0) * (sum(t) + 10000.0)))) for a, b in zip(s, t)]
    rows = []
    for who, x in docs:
        own = hashes(x)
        w = sum(gain[k] for k in own) // len(own) if own else 0
        h = int(hashlib.sha256(f"2024:{'' if who is None else who}".encode()).hexdigest()[:8], 16)
        rows.append((who, len(own), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    fit = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    ranks = defaultdict(list)
    for i, r in enumerate(fit[: share * len(fit) // 100]):
        ranks[r].append(i + 1)
    return sorted(((*r, ranks[r].pop(0) if ranks[r] else None) for r in rows), key=str)


def test_resample_equals_brute_force(spark):
    r = random.Random(9)
    say = lambda n: " ".join(r.choice(["Alpha", "beta", "ÉTÉ", "x1", "été", "naïve", "GAMMA,delta", " "]) for _ in range(n))
    docs = [(i, say(r.choice([3, 19, 20, 40]))) for i in range(120)] + [(None, say(30)), (None, None), (500, ""), (501, None), (7, say(25)), (3, "beta " * 300_000)]
    docs += [(600, say(30))] * 40  # repeated rows, of which some are drawn
    target = [say(50), None, "", "x1 beta"]
    got = resample.resample(spark.createDataFrame([(*d, 1, 2, 3) for d in docs], "doc_id long, text string, score int, _own int, n_words int").repartition(5), spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string"))
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted((tuple(x) for x in got.collect()), key=str) == brute_resample(docs, target)
    none = spark.createDataFrame([], "doc_id long, text string")
    assert resample.resample(none, none).count() == 0 and resample.resample(spark.createDataFrame([(1, say(30))], none.schema), none).first()["rank"] is None


def test_cutoff():
    assert resample.cutoff({5: 2, 3: 4, 9: 1}, 4) == (3, {9: 0, 5: 1, 3: 3}) and resample.cutoff({5: 2}, 0) == (None, {}) and resample.cutoff({}, 3) == (None, {})
