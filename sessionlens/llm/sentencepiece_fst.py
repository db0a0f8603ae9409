"""SentencePiece encoding and decoding as shortest paths of a weighted transducer.

These machines are compiled from the model file and composed with each input:

1. the normaliser: the model's character map, longest match first, then its rules
   for spaces; spaces become marks, and a mark goes before the text;
2. the piece transducer: a trie over characters whose arcs end in pieces; a
   character that no piece spells leaves by its UTF-8 bytes.  In a unigram model an
   arc weighs the piece's negative log probability, in a merge model 1;
3. for merge models the pair acceptor: its state is the last piece, and it lets a piece follow
   another only if merging the characters of both, best piece first, gives just
   these two.  A path that it accepts throughout is the merge order's own
   segmentation, so the model's ids come out, not only some cheap path.  The
   acceptor is built lazily: a pair is tried when it is first met.

The tropical shortest path is found for all different words of a block of text
in lockstep: one vectorised relaxation for each place in a word.  Words end where
no piece of the model spans the two characters, which leaves paths unchanged.
Words met before are remembered up to `MEMORY_WORDS`.

Models without byte fallback, with pieces defined by users or with marks after
words are refused.  Null texts have no ids; the empty text has none either; texts of any length
are encoded whole.  Round trips are to the normalised text, which is the text itself
where a model has no character map.  A text that itself holds the mark U+2581
decodes to a space there, as the model defines.  Equal texts have equal ids and
repeated rows a row each; no rows give no rows.  Other columns pass through;
columns of the names that `encode` and `decode` add are replaced.
"""

import hashlib
import sys
import types

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .langid import code_points
from .store import small_batches
from .text import U64, mix64, utf8_chunks

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = 0x2581
CHUNK = 1 << 20
MEMORY_WORDS = 500_000
_M = 0x9E3779B97F4A7C15


def read_model(path: str) -> dict:
    """Pieces (None where a piece spells nothing), scores, byte ids and the normaliser's settings."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto()
    with open(path, "rb") as f:
        m.ParseFromString(f.read())
    return model_of(m)


def model_of(m) -> dict:
    spec = m.normalizer_spec
    kinds = {p.type for p in m.pieces}
    if not m.trainer_spec.byte_fallback or m.trainer_spec.treat_whitespace_as_suffix or not spec.escape_whitespaces or 4 in kinds or m.trainer_spec.model_type not in (1, 2):
        raise ValueError("only unigram and merge models with byte fallback, marks before words and no pieces defined by users are known")
    bytes_of = {int(p.piece[3:5], 16): k for k, p in enumerate(m.pieces) if p.type == 6}
    return {
        "pieces": [p.piece if p.type == 1 else None for p in m.pieces],
        "scores": [p.score for p in m.pieces],
        "bytes": [bytes_of[b] for b in range(256)],
        "prefix": spec.add_dummy_prefix,
        "squeeze": spec.remove_extra_whitespaces,
        "unigram": m.trainer_spec.model_type == 1,
        "map": character_map(spec.precompiled_charsmap),
    }


def character_map(blob: bytes) -> dict[str, str]:
    """What a compiled character map replaces by what: all strings of its double-array trie."""
    if not blob:
        return {}
    size = int.from_bytes(blob[:4], "little")
    units, values = np.frombuffer(blob[4 : 4 + size], "<u4").astype(np.int64), blob[4 + size :]
    letters = np.arange(1, 256)
    out, todo = {}, [(0, b"")]
    while todo:
        at, spelled = todo.pop()
        unit = int(units[at])
        base = at ^ ((unit >> 10) << ((unit & (1 << 9)) >> 6))
        if unit >> 8 & 1:
            start = int(units[base]) & 0x7FFFFFFF
            out[spelled.decode()] = values[start : values.index(b"\0", start)].decode()
        to = base ^ letters
        ok = to < len(units)
        ok[ok] = (units[to[ok]] & 0x800000FF) == letters[ok]
        todo += [(int(k), spelled + bytes([int(c)])) for k, c in zip(to[ok], letters[ok], strict=True)]
    return out


class Normaliser:
    """The character map and the rules for spaces, as one step over the texts of a block."""

    def __init__(self, rules: dict[str, str], squeeze: bool):
        self.rules, self.squeeze = rules, squeeze
        self.longest = max(map(len, rules), default=0)
        self.single = np.array(sorted({ord(k) for k in rules if len(k) == 1}) or [-1], np.int64)
        self.pairs = np.array(sorted({(ord(k[0]) << 21) | ord(k[1]) for k in rules if len(k) > 1}) or [-1], np.int64)

    def __call__(self, buf, offsets):
        """Bytes and offsets of the normalised texts."""
        if not (self.rules or self.squeeze) or not len(buf):
            return buf, offsets
        codes, at = code_points(buf)
        codes = codes.astype(np.int64)
        cut = np.searchsorted(at, offsets)
        if self.rules:
            codes, cut = self._mapped(codes, cut)
        if self.squeeze:
            space = codes == 32
            first, last = np.zeros(len(codes), bool), np.zeros(len(codes), bool)
            filled = cut[:-1] < cut[1:]
            first[cut[:-1][filled]] = True
            last[cut[1:][filled] - 1] = True
            keep = ~space
            keep[:-1] |= space[:-1] & ~space[1:] & ~last[:-1]  # the last of a run, unless it leads or trails
            lead = np.flatnonzero(keep & space)
            row = np.searchsorted(cut, lead, "right") - 1
            letters = np.concatenate([[0], np.cumsum(~space)])
            keep[lead[letters[lead] == letters[cut[row]]]] = False
            cut = np.concatenate([[0], np.cumsum(keep)])[cut]
            codes = codes[keep]
        size = 1 + (codes >= 0x80).astype(np.int64) + (codes >= 0x800) + (codes >= 0x10000)
        out = np.frombuffer(codes.astype("<u4").tobytes().decode("utf-32-le").encode(), np.uint8)
        return out, np.concatenate([[0], np.cumsum(size)])[cut]

    def _mapped(self, codes, cut):
        def among(table, keys):
            k = np.searchsorted(table, keys)
            k[k == len(table)] = 0
            return table[k] == keys

        some = among(self.single, codes)
        some[:-1] |= among(self.pairs, (codes[:-1] << 21) | codes[1:])
        count, new, done = np.ones(len(codes), np.int64), [], 0
        ends = cut[np.searchsorted(cut, np.arange(len(codes)), "right")] if some.any() else cut
        for k in np.flatnonzero(some).tolist():
            if k < done:
                continue
            text = "".join(map(chr, codes[k : min(k + self.longest, int(ends[k]))].tolist()))
            for n in range(len(text), 0, -1):  # the longest match
                if (to := self.rules.get(text[:n])) is not None:
                    count[k : k + n] = 0
                    count[k] = len(to)
                    new.append((k, to))
                    done = k + n
                    break
        start = np.concatenate([[0], np.cumsum(count)])
        out = np.repeat(codes, count)
        for k, to in new:
            out[start[k] : start[k] + len(to)] = [ord(c) for c in to]
        return out, start[cut]


class Transducer:
    """The compiled machines."""

    def __init__(self, model: dict):
        pieces = model["pieces"]
        self.bytes, self.prefix, self.unigram = np.array(model["bytes"], np.int32), model["prefix"], model["unigram"]
        self.normalise = Normaliser(model["map"], model["squeeze"])
        self.count = len(pieces)
        self.size = np.array([*(len(p) if p else 1 for p in pieces), 1], np.int32)  # after the pieces: a character spelled by bytes
        known = {p: k for k, p in enumerate(pieces) if p}
        self.byte_of = {int(k): b for b, k in enumerate(self.bytes)}
        self.spelled = [bytes([self.byte_of[k]]) if k in self.byte_of else (p or "").replace(chr(MARK), " ").encode() for k, p in enumerate(pieces)]
        # characters and where words may end
        self.chars = np.array(sorted({ord(c) for p in known for c in p}), np.int64)
        spans = np.array(sorted({(ord(a) << 21) | ord(b) for p in known for a, b in zip(p, p[1:], strict=False)}), np.int64)
        self.spans = spans if len(spans) else np.array([-1])
        self.near = np.zeros((1024, 1024), bool)
        a, b = spans >> 21, spans & ((1 << 21) - 1)
        low = (a < 1024) & (b < 1024)
        self.near[a[low], b[low]] = True
        # merges
        merges = {}
        for p, k in known.items():
            for cut in range(1, len(p)):
                if (x := known.get(p[:cut])) is not None and (y := known.get(p[cut:])) is not None:
                    merges[(x << 20) | y] = k
        self.pair_keys = np.array(sorted(merges) or [-1], np.int64)
        self.pair_piece = np.array([merges[k] for k in sorted(merges)] or [0], np.int64)
        self.score = np.array(model["scores"])
        self.weight = np.append(-self.score, 0.0) if self.unigram else np.ones(self.count + 1)
        self.weight[-1] = 10.0 - min((model["scores"][k] for k in known.values()), default=0.0)
        self.alone = np.array(sorted(ord(p) for p in known if len(p) == 1) or [-1], np.int64)
        char_ids = {c: known.get(chr(c), -1) for c in map(int, self.chars)}
        self.char_id = np.array([char_ids[int(c)] for c in self.chars], np.int64)
        longest = int(self.size.max())
        self.spelling = np.full((self.count, longest), -1, np.int64)
        for p, k in known.items():
            self.spelling[k, : len(p)] = [char_ids[ord(c)] for c in p]
        # a piece that its own characters don't merge to is never an arc
        ids = np.array(sorted(known.values()), np.int64)
        if self.unigram:
            usable = set(known.values())
        else:
            merged, n = self.merge(self.spelling[ids])
            usable = {int(k) for k in ids[(n == 1) & (merged[:, 0] == ids)]}
        # trie
        children, piece_at = {}, [-1]
        for p, k in known.items():
            if k not in usable:
                continue
            node = 0
            for c in p:
                key = (node << 21) | ord(c)
                if key not in children:
                    children[key] = len(piece_at)
                    piece_at.append(-1)
                node = children[key]
            piece_at[node] = k
        self.edge_keys = np.array(sorted(children), np.int64)
        self.edge_to = np.array([children[k] for k in sorted(children)], np.int64)
        self.piece_at = np.array(piece_at, np.int64)
        self.known_pairs, self.known_ok = np.zeros(0, np.int64), np.zeros(0, bool)
        self.fresh_pairs, self.fresh_ok = np.zeros(0, np.int64), np.zeros(0, bool)
        self.forget()

    def forget(self):
        self.word_keys, self.word_at, self.word_n, self.flat = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def merge(self, rows):
        """Rows of piece ids (-1 after the last), merged best score first, leftmost first; and how many are left in each."""
        rows = rows.copy()
        n = (rows >= 0).sum(1)
        todo = np.arange(len(rows))
        while len(todo):
            r = rows[todo]
            key = (r[:, :-1] << 20) | r[:, 1:]
            key[(r[:, 1:] < 0) | (r[:, :-1] < 0)] = -2
            at = np.searchsorted(self.pair_keys, key)
            at[at == len(self.pair_keys)] = 0
            to = np.where(self.pair_keys[at] == key, self.pair_piece[at], -1)
            score = np.where(to >= 0, self.score[to], -np.inf)
            best = score.argmax(1)
            some = score[np.arange(len(todo)), best] > -np.inf
            todo, best = todo[some], best[some]
            if not len(todo):
                break
            r = rows[todo]
            r[np.arange(len(todo)), best] = to[some, best]
            source = np.arange(r.shape[1])[None, :] + (np.arange(r.shape[1])[None, :] > best[:, None])
            gone = source >= r.shape[1]
            r = np.take_along_axis(r, np.minimum(source, r.shape[1] - 1), 1)
            r[gone] = -1
            rows[todo] = r
            n[todo] -= 1
        return rows, n

    def may_follow(self, keys):
        """Whether the pairs (a << 20 | b) stay as they are when merged."""
        out = np.zeros(len(keys), bool)
        missing = np.ones(len(keys), bool)
        for table, ok in ((self.known_pairs, self.known_ok), (self.fresh_pairs, self.fresh_ok)):
            if len(table) and missing.any():
                at = np.searchsorted(table, keys)
                at[at == len(table)] = 0
                hit = missing & (table[at] == keys)
                out[hit] = ok[at[hit]]
                missing &= ~hit
        if missing.any():
            new, back = np.unique(keys[missing], return_inverse=True)
            a, b = new >> 20, new & ((1 << 20) - 1)
            ok = np.zeros(len(new), bool)
            for lo in range(0, len(new), 20_000):
                x, y = a[lo : lo + 20_000], b[lo : lo + 20_000]
                rows = np.full((len(x), 2 * self.spelling.shape[1]), -1, np.int64)
                rows[:, : self.spelling.shape[1]] = self.spelling[x]
                place = self.size[x][:, None] + np.arange(self.spelling.shape[1])[None, :]
                np.put_along_axis(rows, place, self.spelling[y], 1)
                merged, n = self.merge(rows)
                ok[lo : lo + 20_000] = (n == 2) & (merged[:, 0] == x) & (merged[:, 1] == y)
            out[missing] = ok[back]
            pairs, oks = np.concatenate([self.fresh_pairs, new]), np.concatenate([self.fresh_ok, ok])
            order = np.argsort(pairs)
            self.fresh_pairs, self.fresh_ok = pairs[order], oks[order]
        return out

    def settle(self):
        pairs, oks = np.concatenate([self.known_pairs, self.fresh_pairs]), np.concatenate([self.known_ok, self.fresh_ok])
        order = np.argsort(pairs, kind="stable")
        self.known_pairs, self.known_ok = pairs[order], oks[order]
        self.fresh_pairs, self.fresh_ok = self.fresh_pairs[:0], self.fresh_ok[:0]

    def shortest(self, seq, n):
        """Ids of the shortest path of each word; words lie one after another in seq, n characters each."""
        first = np.concatenate([[0], np.cumsum(n)])
        place = np.arange(len(seq)) - np.repeat(first[:-1], n)
        end = np.repeat(first[1:], n)
        alive, node = np.arange(len(seq)), np.zeros(len(seq), np.int64)
        arcs = []
        if self.unigram:
            k = np.searchsorted(self.alone, seq)
            k[k == len(self.alone)] = 0
            bare = np.flatnonzero(self.alone[k] != seq)
            arcs.append((bare, np.ones(len(bare), np.int64), np.full(len(bare), self.count)))
        for k in range(self.spelling.shape[1]):
            ok = alive + k < end[alive]
            alive, node = alive[ok], node[ok]
            if not len(alive):
                break
            key = (node << 21) | seq[alive + k]
            at = np.searchsorted(self.edge_keys, key)
            at[at == len(self.edge_keys)] = 0
            ok = self.edge_keys[at] == key
            alive, node = alive[ok], self.edge_to[at[ok]]
            piece = self.piece_at[node]
            whole = piece >= 0
            arcs.append((alive[whole], np.full(int(whole.sum()), k + 1, np.int64), piece[whole]))
        start, size, piece = (np.concatenate(x) for x in zip(*arcs, strict=True))
        word = np.repeat(np.arange(len(n)), n)
        order = np.argsort(place[start], kind="stable")
        start, size, piece = start[order], size[order], piece[order]
        cut = np.searchsorted(place[start], np.arange(int(n.max()) + 1))
        state = start + word[start]  # each word has one state more than characters
        begin = first[:-1] + np.arange(len(n))
        last, cost = np.full(len(seq) + len(n), -2, np.int64), np.full(len(seq) + len(n), np.inf)
        last[begin], cost[begin] = -1, 0.0
        hops = np.zeros(len(seq) + len(n), np.int64)
        for p in range(int(n.max())):
            s, w, x = state[cut[p] : cut[p + 1]], size[cut[p] : cut[p + 1]], piece[cut[p] : cut[p + 1]]
            if self.unigram:
                ok = last[s] != -2
            else:
                prev = last[s]
                ok = prev == -1
                some = np.flatnonzero(prev >= 0)
                if len(some):
                    ok[some] = self.may_follow((prev[some] << 20) | x[some])
            far = cost[s] + self.weight[x]
            ok &= far < cost[s + w]
            to = s[ok] + w[ok]
            last[to], cost[to], hops[to] = x[ok], far[ok], hops[s[ok]] + 1
        at = begin + n
        if (last[at] < 0).any():
            raise AssertionError("a word without an accepted path")
        total = hops[at]
        offset = np.concatenate([[0], np.cumsum(total)])
        out = np.empty(int(offset[-1]), np.int32)
        todo, k = np.arange(len(n)), 1
        while len(todo):
            x = last[at[todo]]
            out[offset[todo] + total[todo] - k] = x
            at[todo] -= self.size[x]
            todo = todo[total[todo] > k]
            k += 1
        return self._spelled_out(out, total, seq, n) if self.unigram and (out == self.count).any() else (out, total)

    def _spelled_out(self, ids, total, seq, n):
        """The arcs of characters without a piece replaced by their bytes."""
        size = self.size[ids]
        place = np.cumsum(size) - size  # words and their ids lie one after another in the same order
        parts = [self.bytes[np.frombuffer(chr(int(seq[p])).encode(), np.uint8)] if k == self.count else np.array([k], np.int32) for k, p in zip(ids, place, strict=True)]
        lengths = np.array([len(x) for x in parts])
        word = np.repeat(np.arange(len(n)), total)
        return np.concatenate(parts).astype(np.int32), np.bincount(word, weights=lengths, minlength=len(n)).astype(np.int64)

    def encode(self, buf, offsets):
        """Flat ids of all rows (normalised texts) and where each row's begin."""
        rows = len(offsets) - 1
        codes, at = code_points(buf)
        codes = codes.astype(np.int64)
        codes[codes == 32] = MARK
        cut = np.searchsorted(at, offsets)
        if self.prefix:
            filled = cut[:-1][cut[:-1] < cut[1:]]
            codes = np.insert(codes, filled, MARK)
            cut = cut + np.concatenate([[0], np.cumsum(cut[:-1] < cut[1:])])
        if not len(codes):
            return np.zeros(0, np.int32), np.zeros(rows + 1, np.int64)
        known = self.chars[np.minimum(np.searchsorted(self.chars, codes), len(self.chars) - 1)] == codes
        a, b = codes[:-1], codes[1:]
        low = (a < 1024) & (b < 1024)
        joined = np.zeros(len(a), bool)
        joined[low] = self.near[a[low], b[low]]
        high = np.flatnonzero(~low)
        key = (a[high] << 21) | b[high]
        k = np.searchsorted(self.spans, key)
        k[k == len(self.spans)] = 0
        joined[high] = self.spans[k] == key
        begin = np.ones(len(codes), bool)
        begin[1:] = ~joined | ~known[1:] | ~known[:-1]
        begin[cut[:-1][cut[:-1] < cut[1:]]] = True
        starts = np.flatnonzero(begin)
        n = np.diff(np.append(starts, len(codes)))
        # a hash of each word
        power = np.cumprod(np.where(np.arange(int(n.max()) + 1) == 0, U64(1), U64(_M)), dtype=np.uint64)
        place = np.arange(len(codes)) - np.repeat(starts, n)
        keys = mix64(np.add.reduceat((codes.astype(np.uint64) + U64(1)) * power[place], starts) + n.astype(np.uint64))
        uniq, one, back = np.unique(keys, return_index=True, return_inverse=True)
        k = np.searchsorted(self.word_keys, uniq)
        if len(self.word_keys):
            k[k == len(self.word_keys)] = 0
            new = self.word_keys[k] != uniq
        else:
            new = np.ones(len(uniq), bool)
        if new.any():
            fresh = one[new]
            size = n[fresh]
            odd = ~known[starts[fresh]]  # one unknown character each
            ids, total = np.zeros(0, np.int32), np.zeros(len(fresh), np.int64)
            plain = np.flatnonzero(~odd)
            parts = []
            if len(plain):
                m = size[plain]
                source = np.repeat(starts[fresh[plain]], m) + np.arange(int(m.sum())) - np.repeat(np.cumsum(m) - m, m)
                ids, total[plain] = self.shortest(codes[source], m)
                self.settle()
            parts.append(ids)
            where = np.zeros(len(fresh), np.int64)
            where[plain] = np.cumsum(total[plain]) - total[plain]
            top = len(ids)
            for j in np.flatnonzero(odd):
                spelled = self.bytes[np.frombuffer(chr(int(codes[starts[fresh[j]]])).encode(), np.uint8)]
                where[j], total[j] = top, len(spelled)
                parts.append(spelled.astype(np.int32))
                top += len(spelled)
            if len(self.word_keys) + len(fresh) > MEMORY_WORDS:
                self.forget()
                if len(uniq) != len(fresh):  # what this block knew is gone too
                    return self.encode(buf, offsets)
            word_keys = np.concatenate([self.word_keys, uniq[new]])
            word_at, word_n = np.concatenate([self.word_at, where + len(self.flat)]), np.concatenate([self.word_n, total])
            order = np.argsort(word_keys, kind="stable")
            self.word_keys, self.word_at, self.word_n = word_keys[order], word_at[order], word_n[order]
            self.flat = np.concatenate([self.flat, *parts])
            k = np.searchsorted(self.word_keys, uniq)
        which = k[back]
        m = self.word_n[which]
        ends = np.cumsum(m)
        out = self.flat[np.repeat(self.word_at[which] - (ends - m), m) + np.arange(int(ends[-1]))]
        per_row = np.searchsorted(starts, cut)
        return out, np.concatenate([[0], ends])[per_row]

    def decode(self, ids) -> bytes:
        """UTF-8 of the text that the ids spell, the space that the normaliser put first left out."""
        out = b"".join(map(self.spelled.__getitem__, ids.tolist()))
        return out[1:] if self.prefix and out[:1] == b" " else out


def _machine(model: dict) -> Transducer:
    """The machine of this worker process; it outlives tasks, and with it the words that it remembers."""
    home = sys.modules.setdefault("_llm_worker_state", types.ModuleType("_llm_worker_state"))
    name = hashlib.sha256(repr(model).encode()).hexdigest()
    if getattr(home, "name", None) != name:
        home.machine, home.name = Transducer(model), name
    return home.machine


def encode(df: DataFrame, model_path: str = MODEL, text: str = "text", out: str = "token_ids", check: str | None = None) -> DataFrame:
    """df plus the ids of `text`; null for null.

    With `check`, also a column of that name: whether the ids decode to the (normalised) text.
    """
    small_batches(df.sparkSession)
    model = read_model(model_path)
    schema = T.StructType([f for f in df.schema.fields if f.name not in (out, check)])
    df = df.select(schema.names)

    def run(batches):
        machine = _machine(model)
        for batch in batches:
            for lo, buf, offsets in utf8_chunks(batch.column(text), CHUNK):
                buf, offsets = machine.normalise(buf, offsets)
                ids, cut = machine.encode(buf, offsets)
                part = batch.slice(lo, len(offsets) - 1)
                none = part.column(text).is_null()
                lists = pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(ids), mask=none)
                columns, names = [*part.columns, lists], [*part.schema.names, out]
                if check:
                    raw = buf.tobytes()
                    same = np.array([machine.decode(ids[cut[k] : cut[k + 1]]) == raw[offsets[k] : offsets[k + 1]] for k in range(len(offsets) - 1)], bool)
                    columns.append(pa.array(same, mask=none.to_numpy(zero_copy_only=False)))
                    names.append(check)
                yield pa.RecordBatch.from_arrays(columns, names)

    kind = T.StructType(list(schema.fields)).add(out, T.ArrayType(T.IntegerType()))
    return df.mapInArrow(run, kind.add(check, "boolean") if check else kind)


def decode(df: DataFrame, model_path: str = MODEL, ids: str = "token_ids", out: str = "decoded") -> DataFrame:
    """df plus the text that the ids spell (bytes that aren't UTF-8 become U+FFFD); null for null."""
    small_batches(df.sparkSession)
    model = read_model(model_path)

    def run(batches):
        machine = _machine(model)
        for batch in batches:
            column = batch.column(ids)
            texts = [None if not column[k].is_valid else machine.decode(column[k].values.to_numpy()).decode("utf-8", "replace") for k in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, out])

    kind = T.StructType([f for f in df.schema.fields if f.name != out]).add(out, "string")
    return df.drop(out).mapInArrow(run, kind)


def transcode_digest(docs: DataFrame, model_path: str = MODEL) -> DataFrame:
    """doc_id, n_tokens, n_byte_tokens, ids_sha256 (of 32-bit little-endian ids), decoded_sha256, round_trip of every document; a null text counts as empty."""
    small_batches(docs.sparkSession)
    model = read_model(model_path)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        machine = _machine(model)
        is_byte = np.zeros(machine.count, bool)
        is_byte[machine.bytes] = True
        for batch in batches:
            for lo, buf, offsets in utf8_chunks(batch.column("text"), CHUNK):
                buf, offsets = machine.normalise(buf, offsets)
                ids, cut = machine.encode(buf, offsets)
                raw = buf.tobytes()
                bytes_before = np.concatenate([[0], np.cumsum(is_byte[ids])])[cut]
                codes, spelled, same = [], [], []
                for k in range(len(offsets) - 1):
                    mine = ids[cut[k] : cut[k + 1]]
                    text = machine.decode(mine)
                    codes.append(hashlib.sha256(mine.astype("<i4").tobytes()).hexdigest())
                    spelled.append(hashlib.sha256(text).hexdigest())
                    same.append(text == raw[offsets[k] : offsets[k + 1]])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(lo, len(codes)), pa.array(np.diff(cut)), pa.array(np.diff(bytes_before)), pa.array(codes), pa.array(spelled), pa.array(same)],
                    ["doc_id", "n_tokens", "n_byte_tokens", "ids_sha256", "decoded_sha256", "round_trip"],
                )

    return docs.select("doc_id", F.col("text")).mapInArrow(run, f"doc_id {kind}, n_tokens long, n_byte_tokens long, ids_sha256 string, decoded_sha256 string, round_trip boolean")
