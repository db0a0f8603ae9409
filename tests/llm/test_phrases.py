"""Phrases against a plain count of everything, with bitmaps so small that most bits are set by others."""

import random
import re
from collections import Counter

import pytest

from sessionlens.llm import phrases


def plain(rows, longest, least, top):
    f, n = Counter(), Counter()
    for lang, text in rows:
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate({c: c + 32 for c in range(65, 91)})):
            w = [x for x in re.split("[ \t]+", piece) if x]
            n[lang or "und"] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    f[lang or "und", tuple(w[i : i + k])] += 1
    cand = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    scored = {}
    for (lang, p), a in cand.items():
        longer = [b for (other, q), b in cand.items() if other == lang and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))]
        if any(100 * b >= 80 * a for b in longer):
            continue
        cuts = [(2000000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        scored.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), a, f[lang, p[:k]], f[lang, p[k:]], n[lang], score))
    return sorted((lang, i, x[2].decode(), *x[3:]) for lang, xs in scored.items() for i, x in enumerate(sorted(xs)[:top], 1))


@pytest.mark.parametrize("bits", [24, 15])
def test_against_counting_all(spark, monkeypatch, bits):
    rng = random.Random(4)
    words = [*"abcdef", "É", "日", "été", "Zz", "x y", "(b)"]
    rows = [(rng.choice(["en", "de", None]), "".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\t", ". ", "\r\n", "!"]) for _ in range(rng.randint(0, 60)))) for _ in range(150)]
    rows += [("en", None), ("de", ""), ("fr", " .,"), ("en", "a b c d " * 400), ("en", "a b c d " * 400), ("und", "q r " * 40)]
    monkeypatch.setattr(phrases, "BITS", bits)
    df = spark.createDataFrame([(a, b, "p", 1) for a, b in rows], "lang string, text string, phrase string, n int")
    for longest, least, top in ((4, 30, 2000), (3, 12, 7)):
        got = sorted(tuple(r) for r in phrases.collocations(df, longest, least, top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())
        assert got == plain(rows, longest, least, top) and len(got) > 5
    assert phrases.collocations(df.limit(0)).count() == 0
