"""Byte-level BPE encoding and decoding by merge replay over the corpus's words.

The ids of a piece of text depend on the piece alone, so pieces are words of a
corpus and each distinct one is encoded once.  A replay lays all words out in one
row of symbols and keeps an inverted index from the token that a pair makes to the
places of such pairs.  Merges are taken off in rank order; each rewrites its places
and looks again at the two neighbours of every place that it touched, nothing else.

Three steps:
1. All documents are split and their words counted (one shuffle of distinct words).
2. The commonest words of the corpus, at most `LEXICON_WORDS` of `MOST_BYTES` bytes,
   are dealt to partitions and replayed.  The result is bounded by these two figures
   and is broadcast.
3. All documents are split again.  Words outside the lexicon are rare; those of a
   block of texts are replayed together by the same routine.
The choice of words changes the work only: ids are those of the plain greedy rule.

Pieces are the matches of the pattern `'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+|
?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+`, found from the classes of neighbouring
characters in whole arrays.  A piece that is a token itself is that token.

Null texts count as empty (`encode` and `decode` keep null), empty ones have no ids;
a text is encoded whole whatever its length (memory follows a block, or one longest
text).  Repeated rows are rows of their own, no rows give no rows, row order and ties
don't matter.  Only the named columns are read, so others may have any name; a column
named as the result is replaced.
"""

import base64
import hashlib
import heapq
from bisect import bisect_right

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import saved, small_batches
from .text import utf8_chunks

RANKS = "byte_bpe_multi_50k.tiktoken"
LEXICON_WORDS, MOST_BYTES = 400_000, 64
BLOCK = 8 << 20
#: Words replayed at once hold so many bytes, or are one word.
REPLAYED = 1 << 20
SHIFT = 32
WHITE, LETTER, NUMBER, OTHER = range(4)


def read_ranks(path: str) -> list[bytes]:
    """The bytes of each token, by rank."""
    with open(path, "rb") as f:
        ranks = {int(rank): base64.b64decode(token) for token, rank in (line.split() for line in f if line.strip())}
    return [ranks[k] for k in range(len(ranks))]


def character_runs() -> tuple[np.ndarray, np.ndarray]:
    """Classes of all code points as runs (class, length), as the library's own patterns tell them."""
    every = "".join(map(chr, (k for k in range(0x110000) if not 0xD800 <= k < 0xE000)))
    table = np.full(0x110000, OTHER, np.uint8)
    for kind, pattern in ((WHITE, r"\s"), (LETTER, r"\p{L}"), (NUMBER, r"\p{N}")):
        probe = tiktoken.Encoding("probe", pat_str=pattern, mergeable_ranks={bytes([k]): k for k in range(256)}, special_tokens={})
        table[np.frombuffer(bytes(probe.encode_ordinary(every)).decode().encode("utf-32-le"), np.uint32)] = kind
    cut = np.concatenate([[0], np.flatnonzero(np.diff(table)) + 1])
    return table[cut], np.diff(np.append(cut, len(table)))


def code_points(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of UTF-8 bytes and where each begins."""
    at = np.flatnonzero((buf & 0xC0) != 0x80)
    first = buf[at].astype(np.int32)
    if len(at) == len(buf):
        return first, at
    size = 1 + (first >= 0xC0) + (first >= 0xE0) + (first >= 0xF0)
    cp = np.where(size == 1, first, first & (0xFF >> (size + 1)))
    for k in (1, 2, 3):
        more = np.flatnonzero(size > k)
        cp[more] = cp[more] << 6 | buf[at[more] + k] & 0x3F
    return cp, at


def piece_starts(buf: np.ndarray, offsets: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Where the pieces of all rows begin, in bytes; pieces leave nothing out and never cross rows."""
    if not len(buf):
        return np.zeros(0, np.int64)
    cp, at = code_points(buf)
    kind, n = classes[cp], len(cp)
    row = np.zeros(n + 1, bool)
    row[np.searchsorted(at, offsets[:-1][offsets[:-1] < offsets[1:]])] = True
    row[n] = True
    run = row.copy()
    run[1:n] |= kind[1:] != kind[:-1]
    start = run[:n].copy()
    # the last of several white characters stands alone, and a space joins what follows
    b = np.flatnonzero(run[1:n] & ~row[1:n] & (kind[:-1] == WHITE)) + 1
    start[b - 1] = True
    start[b[cp[b - 1] == 32]] = False
    # an apostrophe alone between a start and letters takes a known ending with it
    mark = np.flatnonzero((cp[: n - 1] == 39) & start[: n - 1] & run[1:n] & ~row[1:n] & (kind[1:] == LETTER))
    if len(mark):
        one, two = cp[mark + 1], np.where(row[mark + 2], 0, cp[np.minimum(mark + 2, n - 1)])
        char = lambda x: np.isin(one, [ord(c) for c in x])
        pair = char("rv") & (two == ord("e")) | char("l") & (two == ord("l"))
        taken = np.where(char("stmd"), 1, np.where(pair, 2, 0))
        mark, taken = mark[taken > 0], taken[taken > 0]
        start[mark + 1] = False
        after = mark + 1 + taken
        start[after[(after < n) & ~run[after]]] = True
    return at[start]


class Merges:
    """The merges of one vocabulary, and their replay."""

    def __init__(self, tokens: list[bytes]):
        self.tokens = tokens
        self.rank = {t: k for k, t in enumerate(tokens)}
        self.byte = np.array([self.rank[bytes([k])] for k in range(256)], np.int64)
        pairs: dict[int, int] = {}
        get = self.rank.get
        for k, t in enumerate(tokens):  # every way in which two tokens make a third
            for cut in range(1, len(t)):
                if (a := get(t[:cut])) is not None and (b := get(t[cut:])) is not None:
                    pairs[a << SHIFT | b] = k
        self.pairs = pairs
        self.first = np.full((256, 256), -1, np.int32)
        place = {int(v): k for k, v in enumerate(self.byte)}
        for key, k in pairs.items():
            a, b = place.get(key >> SHIFT), place.get(key & (1 << SHIFT) - 1)
            if a is not None and b is not None:
                self.first[a, b] = k

    def greedy(self, word: bytes) -> list[int]:
        """Ids of one word: the pair of least rank, of several the first, again and again."""
        sym = self.byte[np.frombuffer(word, np.uint8)].tolist()
        n, pairs = len(sym), self.pairs
        after, before = [*range(1, n), -1], list(range(-1, n - 1))
        heap = [(t, p) for p in range(n - 1) if (t := pairs.get(sym[p] << SHIFT | sym[p + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            t, p = heapq.heappop(heap)
            q = after[p]
            if sym[p] < 0 or q < 0 or pairs.get(sym[p] << SHIFT | sym[q]) != t:
                continue
            sym[p], sym[q], r = t, -1, after[q]
            after[p] = r
            if r >= 0:
                before[r] = p
                if (x := pairs.get(t << SHIFT | sym[r])) is not None:
                    heapq.heappush(heap, (x, p))
            if (left := before[p]) >= 0 and (x := pairs.get(sym[left] << SHIFT | t)) is not None:
                heapq.heappush(heap, (x, left))
        return [s for s in sym if s >= 0]

    def replay(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words data[offsets[k]:offsets[k + 1]] (none empty) and their bounds, by merges in rank order."""
        n = len(data)
        sym, pairs = self.byte[data].tolist(), self.pairs
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        after[offsets[1:] - 1] = -1
        before[offsets[:-1]] = -1
        made = self.first[data[:-1], data[1:]]
        made[offsets[1:-1] - 1] = -1
        places = np.flatnonzero(made >= 0)
        places = places[np.argsort(made[places], kind="stable")]
        ranks, cut = np.unique(made[places], return_index=True)
        index = {int(r): p.tolist() for r, p in zip(ranks, np.split(places, cut[1:]), strict=False)}  # nothing to merge: no ranks, one empty part
        after, before = after.tolist(), before.tolist()
        waiting = list(index)  # ascending, so a heap
        odd = set()
        while waiting:
            t = heapq.heappop(waiting)
            for p in sorted(index.pop(t)):
                q = after[p]
                if sym[p] < 0 or q < 0 or pairs.get(sym[p] << SHIFT | sym[q]) != t:
                    continue  # a merge meanwhile took one of the two
                r = after[q]
                sym[p], sym[q], after[p] = t, -1, r
                left = before[p]
                if r >= 0:
                    before[r] = p
                for place, key in ((left, sym[left] << SHIFT | t if left >= 0 else -1), (p, t << SHIFT | sym[r] if r >= 0 else -1)):
                    x = pairs.get(key) if key >= 0 else None
                    if x is None:
                        continue
                    if x < t:  # a merge of an earlier rank became possible: its turn comes before other places of this word
                        odd.add(bisect_right(offsets, p) - 1)
                    if x in index:
                        index[x].append(place)
                    else:
                        index[x] = [place]
                        heapq.heappush(waiting, x)
        ids = np.array(sym, np.int64)
        alive = ids >= 0
        cut = np.concatenate([[0], np.cumsum(alive)])[offsets]
        ids = ids[alive].astype(np.int32)
        if odd:
            parts = np.split(ids, cut[1:-1])
            for k in odd:
                parts[k] = np.array(self.greedy(data[offsets[k] : offsets[k + 1]].tobytes()), np.int32)
            ids, cut = np.concatenate(parts), np.concatenate([[0], np.cumsum([len(x) for x in parts])])
        return ids, cut

    def encode_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words (binary, none empty) and their bounds: tokens as they are, the rest replayed in parts of about REPLAYED bytes."""
        offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
        if not len(words):
            return np.zeros(0, np.int32), np.zeros(1, np.int64)
        data = np.frombuffer(words.buffers()[2], np.uint8)
        get = self.rank.get
        known = np.array([-1 if (k := get(w)) is None else k for w in words.to_pylist()], np.int64)
        size = np.ones(len(words), np.int64)
        rest = np.flatnonzero(known < 0)
        length = (offsets[1:] - offsets[:-1])[rest]
        part = np.cumsum(length) // REPLAYED
        ids_of = []
        for which in np.split(np.arange(len(rest)), np.flatnonzero(np.diff(part)) + 1) if len(rest) else ():
            own = np.concatenate([[0], np.cumsum(length[which])])
            bytes_ = data[np.repeat(offsets[rest[which]] - own[:-1], length[which]) + np.arange(own[-1])]
            ids, cut = self.replay(bytes_, own)
            size[rest[which]] = np.diff(cut)
            ids_of.append(ids)
        cut = np.concatenate([[0], np.cumsum(size)])
        out = np.empty(cut[-1], np.int32)
        slot = np.repeat(known < 0, size)
        out[~slot] = known[known >= 0]
        if ids_of:
            out[slot] = np.concatenate(ids_of)
        return out, cut


def gathered(flat: np.ndarray, cut: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """flat[cut[k]:cut[k + 1]] for each k of `which`, one after the other, and their bounds."""
    size = (cut[1:] - cut[:-1])[which]
    ends = np.concatenate([[0], np.cumsum(size)])
    return flat[np.repeat(cut[which] - ends[:-1], size) + np.arange(ends[-1])], ends


class Encoder:
    """Encodes blocks of texts in a task: a vocabulary's merges and the corpus's lexicon."""

    def __init__(self, tokens: list[bytes], runs: tuple[np.ndarray, np.ndarray], lexicon: pa.Table | None = None):
        self.merges, self.classes = Merges(tokens), np.repeat(*runs)
        size = np.array([len(t) for t in tokens])
        self.spelled, self.spelled_at = np.frombuffer(b"".join(tokens), np.uint8), np.concatenate([[0], np.cumsum(size)])
        self.words = self.ids = None
        if lexicon is not None and lexicon.num_rows:
            self.words = lexicon.column("word").combine_chunks()
            lists = lexicon.column("ids").combine_chunks()
            self.ids, self.cut = lists.values.to_numpy(), lists.offsets.to_numpy().astype(np.int64)

    def pieces(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[pa.DictionaryArray, np.ndarray]:
        """The pieces of a block by distinct word, and the bounds of each row's pieces."""
        starts = piece_starts(buf, offsets, self.classes)
        bounds = np.append(starts, len(buf)).astype(np.int32)
        words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(buf))])
        return words.dictionary_encode(), np.searchsorted(starts, offsets)

    def encode(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows of a block, and the bounds of each row's."""
        pieces, rows = self.pieces(buf, offsets)
        words = pieces.dictionary
        known = np.full(len(words), -1, np.int64)
        if self.words is not None:
            known = pc.fill_null(pc.index_in(words, value_set=self.words), -1).to_numpy().astype(np.int64)
        rare = np.flatnonzero(known < 0)
        flat, cut = self.merges.encode_words(words.take(pa.array(rare)))
        if len(rare) < len(words):
            known[rare] = len(self.words) + np.arange(len(rare))
            flat, cut = np.concatenate([self.ids, flat]), np.concatenate([self.cut, self.cut[-1] + cut[1:]])
        ids, ends = gathered(flat, cut, known[pieces.indices.to_numpy()] if len(rare) < len(words) else pieces.indices.to_numpy())
        return ids, ends[rows]

    def decode(self, ids: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes that the ids of all rows spell, and the bounds of each row's."""
        data, ends = gathered(self.spelled, self.spelled_at, ids)
        return data, ends[cut]


def blocks(batches, most: int = BLOCK):
    """Batches put together until they hold about `most` bytes."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= most:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
    if held and (whole := pa.Table.from_batches(held).combine_chunks()).num_rows:
        yield whole.to_batches()[0]


def word_counts(df: DataFrame, runs, text: str = "text") -> DataFrame:
    """word (binary, at most MOST_BYTES bytes), n of all documents."""

    def run(batches):
        encoder = Encoder([bytes([k]) for k in range(256)], runs)
        for batch in blocks(batches):
            for _, buf, offsets in utf8_chunks(batch.column(text), BLOCK):
                pieces, _ = encoder.pieces(buf, offsets)
                n = np.bincount(pieces.indices.to_numpy(), minlength=len(pieces.dictionary))
                short = pc.less_equal(pc.binary_length(pieces.dictionary), MOST_BYTES)
                yield pa.RecordBatch.from_arrays([pieces.dictionary.filter(short), pa.array(n).filter(short)], ["word", "n"])

    counts = df.select(text).mapInArrow(run, "word binary, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n"))


def corpus_lexicon(df: DataFrame, tokens: list[bytes], runs, most: int = LEXICON_WORDS, text: str = "text") -> pa.Table:
    """word, ids of the commonest words of the corpus, `most` at most.

    Words are taken by bands of counts, from the highest on, as long as whole bands fit.
    """
    counts = saved(word_counts(df, runs, text).where("n > 1").withColumn("band", F.floor(8 * F.log2(F.col("n").cast("double"))).cast("int")))
    least, total = None, 0
    for r in sorted(counts.groupBy("band").count().collect(), reverse=True):  # at most 8 * 63 bands
        total += r["count"]
        if total > most:
            break
        least = r["band"]
    kind = "word binary, ids array<int>"

    def run(batches):
        merges = Merges(tokens)
        for batch in batches:
            ids, cut = merges.encode_words(batch.column("word"))
            yield pa.RecordBatch.from_arrays([batch.column("word"), pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(ids))], ["word", "ids"])

    if least is None:
        return pa.table({"word": pa.array([], pa.binary()), "ids": pa.array([], pa.list_(pa.int32()))})
    return counts.where(F.col("band") >= least).select("word").repartition(24, "word").mapInArrow(run, kind).toArrow()


class Shared:
    """What a job's tasks share, broadcast once."""

    def __init__(self, df: DataFrame, path: str | None, text: str | None):
        small_batches(df.sparkSession)
        tokens, runs = read_ranks(path or public_tokenizers.path(RANKS)), character_runs()
        lexicon = corpus_lexicon(df, tokens, runs, text=text) if text else None
        self.value = df.sparkSession.sparkContext.broadcast((tokens, runs, lexicon))

    def encoder(self) -> Encoder:
        return Encoder(*self.value.value)


def encode(df: DataFrame, path: str | None = None, text: str = "text", out: str = "token_ids") -> DataFrame:
    """df plus the ids of `text` by the ranks in the file `path`; null for null."""
    shared = Shared(df, path, text)
    df = df.select([f.name for f in df.schema.fields if f.name != out])

    def run(batches):
        encoder = shared.encoder()
        for batch in blocks(batches):
            for lo, buf, offsets in utf8_chunks(batch.column(text), BLOCK):
                ids, cut = encoder.encode(buf, offsets)
                part = batch.slice(lo, len(offsets) - 1)
                lists = pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(ids), mask=part.column(text).is_null())
                yield pa.RecordBatch.from_arrays([*part.columns, lists], [*part.schema.names, out])

    return df.mapInArrow(run, T.StructType(list(df.schema.fields)).add(out, T.ArrayType(T.IntegerType())))


def decode(df: DataFrame, path: str | None = None, ids: str = "token_ids", out: str = "decoded") -> DataFrame:
    """df plus the text that the ids spell (bytes that aren't UTF-8 become U+FFFD); null for null."""
    shared = Shared(df, path, None)
    df = df.select([f.name for f in df.schema.fields if f.name != out])

    def run(batches):
        encoder = shared.encoder()
        for batch in batches:
            column = batch.column(ids)
            texts = []
            for x in column:
                data, _ = encoder.decode(x.values.to_numpy(), np.array([0])) if x.is_valid else (None, None)
                texts.append(None if data is None else data.tobytes().decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, out])

    return df.mapInArrow(run, T.StructType(list(df.schema.fields)).add(out, "string"))


def transcode_digest(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of 32-bit little-endian ids), decoded_sha256, round_trip of every document."""
    shared = Shared(docs, path, "text")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        encoder = shared.encoder()
        for batch in blocks(batches):
            for lo, buf, offsets in utf8_chunks(batch.column("text"), BLOCK):
                ids, cut = encoder.encode(buf, offsets)
                data, ends = encoder.decode(ids, cut)
                n, raw = len(cut) - 1, ids.astype("<u4")
                codes = [hashlib.sha256(raw[cut[k] : cut[k + 1]]).hexdigest() for k in range(n)]
                spelled = [hashlib.sha256(data[ends[k] : ends[k + 1]]).hexdigest() for k in range(n)]
                same = [np.array_equal(data[ends[k] : ends[k + 1]], buf[offsets[k] : offsets[k + 1]]) for k in range(n)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, n), pa.array(np.diff(cut)), pa.array(codes), pa.array(spelled), pa.array(same)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "round_trip"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, round_trip boolean")
