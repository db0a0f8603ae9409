"""Spelling variants against plain definitions: every checksum, every pair, every chain."""

import random
import re
import zlib
from collections import Counter

import numpy as np

from sessionlens.llm import spelling

COLUMNS = ["word", "form", "root", "n", "n_near", "form_n"]


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def plain(rows):
    n = Counter()
    for doc_id, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(c.lower() if c <= "Z" else c for c in w)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{w}".encode())
            n[w[: h % len(w)] + w[h % len(w) + 1 :] if h % 97 == 0 else w] += 1
    n = {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}
    near = {w: [x for x in n if one_apart(w, x)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return sorted(out)


def got(df):
    return sorted(tuple(r) for r in spelling.spelling_variants(df).select(COLUMNS).collect())


def rows(seed=1):
    rng = random.Random(seed)
    base = ["harbour", "harbor", "colour", "Straße", "naïveté", "ÀÉîõü", "lantern", "mississippi", "aaaaa", "×÷×÷×÷"]
    out = []
    for k in range(300):
        text = []
        for _ in range(40):
            w = rng.choice(base)
            if rng.random() < 0.4:
                at = rng.randrange(len(w) + 1)
                w = w[:at] + rng.choice(["", rng.choice("abÿ")]) + w[at + rng.randrange(2) :]
            text.append(w)
        out.append((k * 7, rng.choice([" ", ", ", "1", "Ā"]).join(text)))
    return out + [(1, None), (2, ""), (None, "harbour " * 5), (7, out[1][1]), (9, "z" * 9000 + " "), (10, "z" * 9000), (11, "y" + "z" * 8999 + " " + "z" * 9000), (12, "longer" * 3000), (13, "qqqqq " * 40 + "qqqqr " * 15 + "qqqrr " * 5)]


def test_against_all_pairs(spark, monkeypatch):
    mine = rows()
    df = spark.createDataFrame([(*r, "w", 1) for r in mine], "doc_id long, text string, word string, n int")
    want = plain(mine)
    assert got(df) == want and len(want) > 150 and any(w[2] not in (w[0], w[1]) for w in want)
    monkeypatch.setattr(spelling, "SHARD_BYTES", 300)
    monkeypatch.setattr(spelling, "GROUP_BYTES", 1000)
    assert got(df) == want
    assert got(df.limit(0)) == []


def test_neighbours_of_random_words():
    rng = random.Random(5)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(1, 7))).encode() for _ in range(900)})
    trie = spelling.Trie(*spelling.Trie.packed(words, list(range(1, len(words) + 1))))
    for w in words + [b"", b"d", b"abcabcab"]:
        assert sorted(x for _, x in trie.neighbours(w)) == [x for x in words if one_apart(w.decode(), x.decode())]
    assert dict((x, n) for n, x in trie.neighbours(words[10])) == {x: k + 1 for k, x in enumerate(words) if one_apart(words[10].decode(), x.decode())}


def test_joint_checksums():
    rng = random.Random(2)
    a, b = [rng.randbytes(rng.randint(0, 20)) for _ in range(400)], [rng.randbytes(rng.randint(0, 255)) for _ in range(400)]
    first, second = (np.array([zlib.crc32(x) for x in y], np.uint32) for y in (a, b))
    both = spelling.joint_checksums(first, second, np.array([len(x) for x in b]), spelling._shift_tables())
    assert both.tolist() == [zlib.crc32(x + y) for x, y in zip(a, b)]
