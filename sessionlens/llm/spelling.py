"""Spelling variants grouped by tries and Levenshtein automata.

Words are counted over all documents.  Frequent enough ones are sorted by ranges and
become tries, each of at most `SHARD_BYTES` letters (or one longer word), kept as a table.
Groups of tries of at most `GROUP_BYTES` letters are broadcast one after the other, so
what is sent has a bound that doesn't grow with the vocabulary.  Every word's automaton
of distance one walks every trie depth first: on the path that spells the word it may
still spend its one edit, off that path only the word's own next letters lead on.
Each trie gives one row a word, its number of accepting neighbours and the best of
them; rows are reduced by word.

A word's form is its most frequent neighbour if that is at least `FACTOR` times as
frequent; following forms ends at the root.  Frequencies at least double on the way,
so the way is short, and jumping halves it each round.

Words are runs of A-Z, a-z and U+00C0 to U+00FF, so a letter is one byte of Latin-1 here.
Null and empty texts have no words, a null doc_id counts as an empty one; texts and words of any
length are taken whole (memory follows a block, or one longest text).  Of neighbours
of equal frequency the smallest in code-point order is the best.  Repeated rows count
again, no rows give no rows.  Only doc_id and text are read, so other columns may have
any name.
"""

import zlib
from array import array
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .byte_bpe import blocks
from .store import checkpointed, saved, small_batches
from .text import LOWER, utf8_chunks

LEAST_LETTERS, LEAST, FACTOR = 5, 3, 2
BLOCK = 8 << 20
SHARD_BYTES, GROUP_BYTES = 4 << 20, 16 << 20
WORDS_A_TASK = 20_000
MOST_ROUNDS = 64
#: One in so many words of a document loses a letter.
SLIP = 97
TABLED = 256  # longer words' checksums are taken one by one

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True


def _shift_tables() -> np.ndarray:
    """[length, byte, value]: what a checksum's byte becomes when `length` more bytes follow (the register's linear map)."""
    step = np.array([zlib.crc32(bytes([k])) ^ zlib.crc32(b"\0") for k in range(256)], np.uint32)
    now = (np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]).astype(np.uint32)
    out = [now]
    for _ in range(TABLED - 1):
        now = now >> np.uint32(8) ^ step[now & np.uint32(255)]
        out.append(now)
    return np.array(out)


def joint_checksums(first: np.ndarray, second: np.ndarray, length: np.ndarray, tables: np.ndarray) -> np.ndarray:
    """crc32(a + b) from crc32(a), crc32(b) and the length of b, which is under TABLED."""
    out = second.copy()
    for k in range(4):
        out ^= tables[length, k, first >> np.uint32(8 * k) & np.uint32(255)]
    return out


def runs_of(buf: np.ndarray, offsets: np.ndarray, least: int) -> tuple[pa.DictionaryArray, np.ndarray]:
    """Lower-cased runs of at least `least` letters by distinct run, and each one's row."""
    buf = LOWER[buf]
    pair = np.zeros(len(buf), bool)
    pair[:-1] = buf[:-1] == 0xC3  # U+00C0 to U+00FF are 0xC3 and one byte more
    letter = _LETTER[buf] | pair
    letter[1:] |= pair[:-1]
    first, last = letter.copy(), letter.copy()
    first[1:] &= ~letter[:-1]
    last[:-1] &= ~letter[1:]
    filled = offsets[:-1] < offsets[1:]
    heads, tails = offsets[:-1][filled], offsets[1:][filled] - 1
    first[heads], last[tails] = letter[heads], letter[tails]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(np.searchsorted(starts, offsets)))
    letters = np.concatenate([[0], np.cumsum(letter & ~pair)])
    long = letters[ends] - letters[starts] >= least
    edge = np.zeros(len(buf) + 1, np.int8)
    edge[starts[long]] = 1
    edge[ends[long]] -= 1
    bounds = np.concatenate([[0], np.cumsum((ends - starts)[long])]).astype(np.int32)
    words = pa.Array.from_buffers(pa.string(), int(long.sum()), [None, pa.py_buffer(bounds), pa.py_buffer(buf[np.cumsum(edge[:-1]) > 0])])
    return words.dictionary_encode(), row[long]


def word_counts(docs: DataFrame, least_letters: int = LEAST_LETTERS, slip: int = SLIP) -> DataFrame:
    """word, n of all documents.

    A word whose checksum with its document's id `slip` divides loses the letter that the checksum names.
    """
    small_batches(docs.sparkSession)

    def run(batches):
        tables = _shift_tables()
        for batch in blocks(batches, BLOCK):
            ids = batch.column("id").to_pylist()
            for lo, buf, offsets in utf8_chunks(batch.column("text"), BLOCK):
                runs, row = runs_of(buf, offsets, least_letters)
                words = runs.dictionary.to_pylist()
                codes = [w.encode() for w in words]
                crc, size = np.array([zlib.crc32(c) for c in codes], np.uint32), np.array([len(c) for c in codes], np.int64)
                head = np.array([zlib.crc32(f"{x}:".encode()) for x in ids[lo : lo + len(offsets) - 1]], np.uint32)
                which = runs.indices.to_numpy()
                h = joint_checksums(head[row], crc[which], np.minimum(size, TABLED - 1)[which], tables)
                for k in np.flatnonzero(size[which] >= TABLED):
                    h[k] = zlib.crc32(codes[which[k]], int(head[row[k]]))
                slips = h % np.uint32(slip) == 0
                lost = Counter()
                for w, x in zip(which[slips].tolist(), h[slips].tolist(), strict=True):
                    word = words[w]
                    at = x % len(word)
                    if len(word) > least_letters:
                        lost[word[:at] + word[at + 1 :]] += 1
                n = np.bincount(which[~slips], minlength=len(words))
                there = n > 0
                yield pa.RecordBatch.from_arrays([runs.dictionary.filter(pa.array(there)), pa.array(n[there])], ["word", "n"])
                yield pa.RecordBatch.from_arrays([pa.array(list(lost), pa.string()), pa.array(list(lost.values()), pa.int64())], ["word", "n"])

    counts = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), "text").mapInArrow(run, "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n"))


class Trie:
    """A trie in three arrays: nodes by depth, a node's children side by side in order of their letters."""

    def __init__(self, labels: bytes, first: bytes, counts: bytes):
        self.labels, self.first, self.counts = labels, array("I"), array("q")
        self.first.frombytes(first)
        self.counts.frombytes(counts)

    @staticmethod
    def packed(words: list[bytes], n: list[int]) -> tuple[bytes, bytes, bytes]:
        """The arrays of sorted distinct words and their counts, level by level."""
        size = np.array([len(w) for w in words], np.int64)
        data = np.frombuffer(b"".join(words), np.uint8)
        start = np.cumsum(size) - size
        node, counts = np.zeros(len(words), np.int64), np.array(n, np.int64)
        labels, parents, ends, total = [np.zeros(1, np.uint8)], [], [], 1
        live, depth = np.arange(len(words)), 0
        while len(live := live[size[live] > depth]):
            letter, parent = data[start[live] + depth], node[live]
            new = np.ones(len(live), bool)
            new[1:] = (letter[1:] != letter[:-1]) | (parent[1:] != parent[:-1])
            node[live] = total - 1 + np.cumsum(new)
            labels.append(letter[new])
            parents.append(parent[new])
            total += int(new.sum())
            depth += 1
        parents = np.concatenate(parents) if parents else np.zeros(0, np.int64)
        ends = np.zeros(total, np.int64)
        ends[node] = counts
        first = 1 + np.searchsorted(parents, np.arange(total + 1))
        return np.concatenate(labels).tobytes(), first.astype(np.uint32).tobytes(), ends.tobytes()

    def neighbours(self, word: bytes) -> list[tuple[int, bytes]]:
        """(count, word) of all words at distance one.

        A state is the number of letters used without an edit, or one of three with it: one
        fewer than the trie's depth, as many, or one more (bits 1, 2, 4).
        """
        labels, first, counts, size = self.labels, self.first, self.counts, len(word)
        out = []
        stack = [(0, 0, True, 0, b"")]
        while stack:
            node, depth, exact, bits, path = stack.pop()
            if exact and depth < size:
                bits |= 4  # the word's next letter left out
            if counts[node] and bits and (depth - 1 == size and bits & 1 or depth == size and bits & 2 and not exact or depth + 1 == size and bits & 4):
                out.append((counts[node], path))
            lo, hi = first[node], first[node + 1]
            if lo == hi:
                continue
            a = word[depth - 1] if bits & 1 and depth <= size else -1
            b = word[depth] if bits & 2 and depth < size else -1
            c = word[depth + 1] if bits & 4 and depth + 1 < size else -1
            if exact:
                own = word[depth] if depth < size else -1
                for child in range(lo, hi):
                    x = labels[child]
                    # another letter in its place (if there is a place), or one more letter
                    after = 1 | (2 if depth < size and x != own else 0) | (1 if x == a else 0) | (2 if x == b else 0) | (4 if x == c else 0)
                    stack.append((child, depth + 1, x == own, after, path + labels[child : child + 1]))
                continue
            for x in {a, b, c}:
                if x >= 0 and (child := labels.find(x, lo, hi)) >= 0:
                    stack.append((child, depth + 1, False, (1 if x == a else 0) | (2 if x == b else 0) | (4 if x == c else 0), path + labels[child : child + 1]))
        return out


def trie_shards(words: DataFrame) -> DataFrame:
    """shard, letters, labels, first, counts: tries over the sorted words (word, n), each of at most SHARD_BYTES letters or one word."""
    letters = words.agg(F.sum(F.char_length("word"))).head()[0] or 0

    def run(batches):
        names, n, size = [], [], 0

        def made():
            return pa.RecordBatch.from_arrays([pa.array([names[0].decode("latin-1")]), pa.array([size]), *(pa.array([x], pa.binary()) for x in Trie.packed(names, n))], ["head", "letters", "labels", "first", "counts"])

        for batch in batches:
            for w, k in zip(batch.column("word").to_pylist(), batch.column("n").to_pylist(), strict=True):
                if names and size + len(w) > SHARD_BYTES:
                    yield made()
                    names, n, size = [], [], 0
                names.append(w.encode("latin-1"))
                n.append(k)
                size += len(w)
        if names:
            yield made()

    ranged = words.select("word", "n").repartitionByRange(-(-letters // SHARD_BYTES) or 1, "word").sortWithinPartitions("word")
    return ranged.mapInArrow(run, "head string, letters long, labels binary, first binary, counts binary")


def near_words(words: DataFrame) -> DataFrame:
    """word, n_near, best, best_n of the words (word, n) that have neighbours among themselves."""
    spark = words.sparkSession
    shards = saved(trie_shards(words))
    groups, room = [], 0
    for head, letters in shards.select("head", "letters").orderBy("head").collect():  # a row a shard
        if not groups or letters > room:
            groups.append([])
            room = GROUP_BYTES
        groups[-1].append(head)
        room -= letters
    found, parts = None, -(-words.count() // WORDS_A_TASK) or 1
    for heads in groups:
        rows = shards.where(F.col("head").between(heads[0], heads[-1])).select("labels", "first", "counts").collect()  # GROUP_BYTES letters at most
        tries = spark.sparkContext.broadcast([tuple(map(bytes, r)) for r in rows])

        def run(batches, tries=tries):
            walk = [Trie(*t).neighbours for t in tries.value]
            for batch in batches:
                word, near, best, most = [], [], [], []
                for w in batch.column("word").to_pylist():
                    code = w.encode("latin-1")
                    got = [x for f in walk for x in f(code)]
                    if got:
                        n, form = min(got, key=lambda x: (-x[0], x[1]))
                        word.append(w)
                        near.append(len(got))
                        best.append(form.decode("latin-1"))
                        most.append(n)
                yield pa.RecordBatch.from_arrays([pa.array(word, pa.string()), pa.array(near, pa.int64()), pa.array(best, pa.string()), pa.array(most, pa.int64())], ["word", "n_near", "best", "best_n"])

        # dealt out in tasks of so many words: a word costs far more here than a row elsewhere
        part = words.select("word").repartition(parts, "word").mapInArrow(run, "word string, n_near long, best string, best_n long")
        part = saved(part)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], "word string, n_near long, best string, best_n long")
    top = F.min(F.struct((-F.col("best_n")).alias("m"), "best"))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), top.alias("t")).select("word", "n_near", F.col("t.best").alias("best"), (-F.col("t.m")).alias("best_n"))


def roots(forms: DataFrame) -> DataFrame:
    """word, root of words with forms (word, form): the last of the chain, by pointer jumping."""
    up = checkpointed(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("far")))
    for _ in range(MOST_ROUNDS):
        if not up.where("far").head(1):
            return up.drop("far")
        above = up.select(F.col("word").alias("root"), F.col("root").alias("top"))
        up = checkpointed(up.join(above, "root", "left").select("word", F.coalesce("top", "root").alias("root"), F.col("top").isNotNull().alias("far")))
    raise RuntimeError(f"forms not settled after {MOST_ROUNDS} rounds")


def spelling_variants(docs: DataFrame, least: int = LEAST, factor: int = FACTOR) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word that occurs `least` times."""
    words = saved(word_counts(docs).where(F.col("n") >= least))
    enough = F.col("best_n") >= factor * F.col("n")
    out = words.join(near_words(words), "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(enough, F.col("best")).alias("form"), F.when(enough, F.col("best_n")).alias("form_n"))
    out = saved(out)
    ends = roots(out.where("form is not null"))
    return out.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
