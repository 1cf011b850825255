"""SentencePiece encoding and decoding (operator 12): a prefix table for merge-type models.

In an encoding by merges, the tokens before any token boundary are the encoding of the text before it,
and a sequence of tokens is an encoding exactly if each adjacent pair is: the first merge across a
boundary would also happen in the pair alone, as merges come in an order (by score, then from the
left) that a part of the text keeps.  So every prefix of a text has one last token: of the tokens that
an automaton finds to end there, the one that is compatible with the last token of the prefix before
it.  The table of these tokens is filled from the left, and ids are read off it backwards.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm import kernel

#: The model's sign for a space.
BLANK = "▁"
#: Chunks that a worker remembers (twice as many at most), longest chunk remembered, pairs remembered.
KEPT_CHUNKS, KEPT_LENGTH, KEPT_PAIRS = 1 << 18, 48, 1 << 20
#: Bytes of texts handed to the encoder at once, characters encoded at once, and those of a long text cut
#: into chunks at once.
BLOCK_BYTES, BLOCK_CHARS, PART_CHARS = 1 << 21, 1 << 20, 1 << 16

# Where a text may be cut: before a blank that follows another character, or nowhere.  The cut depends on
# the two characters alone, so if it leaves every piece of the vocabulary whole, no piece ever spans one.
_RULES = [re.compile(rf"{BLANK}*[^{BLANK}]+|{BLANK}+", re.S), re.compile(r".+", re.S)]
_NEXT_BLANK = re.compile(rf"(?<=[^{BLANK}]){BLANK}")


@dataclass
class Merges:
    """The tables of a model.  A symbol is a piece's id, or beyond them the number of a character that
    only stands inside pieces; ``time`` orders merges by the symbol they make, 0 for characters."""

    symbols: dict[str, int]
    joined: dict[int, int]
    time: list[float]
    split: dict[int, tuple[int, int]]
    odd: set[int]
    n_pieces: int
    byte_ids: list[int]
    unknown: int
    rule: int
    plain: bool

    def key(self, a: int, b: int) -> int:
        return a << 24 | b

    def simulate(self, symbols: list[int]) -> tuple[list[int], tuple[int, int] | None]:
        """All merges carried out one by one: what is left, and the two parts of the last merge."""
        made = None
        while len(symbols) > 1:
            found = [(self.time[z], i, z) for i, z in enumerate(self.joined.get(self.key(a, b)) for a, b in zip(symbols, symbols[1:])) if z is not None]
            if not found:
                break
            _, i, z = min(found)
            made = symbols[i], symbols[i + 1]
            symbols = symbols[:i] + [z] + symbols[i + 2 :]
        return symbols, made

    def letters(self, symbol: int) -> list[int]:
        """The characters that a symbol is made of."""
        parts = self.split.get(symbol)
        return [symbol] if parts is None else self.letters(parts[0]) + self.letters(parts[1])

    def edge(self, symbol: int, side: int) -> list[int]:
        """What stands at one end of a symbol while it is merged: from the character up to the symbol."""
        out = [symbol]
        while out[-1] in self.split:
            out.append(self.split[out[-1]][side])
        return out[::-1]

    def compatible(self, a: int, b: int) -> bool:
        """Whether the encoding of a's and b's characters is a, b."""
        if a in self.odd or b in self.odd:
            return self.simulate(self.letters(a) + self.letters(b))[0] == [a, b]
        left, right = self.edge(a, 1), self.edge(b, 0)
        i = j = 0
        while True:
            left_ends = self.time[left[i + 1]] if i + 1 < len(left) else float("inf")
            right_ends = self.time[right[j + 1]] if j + 1 < len(right) else float("inf")
            z = self.joined.get(self.key(left[i], right[j]))
            if z is not None and self.time[z] < left_ends and self.time[z] <= right_ends:
                return False  # they meet and merge before either is merged into its own token
            if i + 1 == len(left) and j + 1 == len(right):
                return True
            if left_ends <= right_ends:
                i += 1
            else:
                j += 1


def merges(model: bytes) -> Merges:
    """The tables of a merge-type model: built once on the driver, their size is the vocabulary's."""
    library = _library(model)
    n = library.get_piece_size()
    plain = [i for i in range(n) if not (library.is_byte(i) or library.is_control(i) or library.is_unknown(i) or library.is_unused(i))]
    symbols = {library.id_to_piece(i): i for i in plain}
    time = [-library.get_score(i) for i in range(n)]
    for c in sorted({c for piece in symbols for c in piece} - set(symbols)):
        symbols[c] = len(time)
        time.append(0.0)
    byte_ids = [library.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
    rule = next(k for k, r in enumerate(_RULES) if all(r.findall(p) == [p] for p in symbols))
    out = Merges(symbols, {}, time, {}, set(), n, byte_ids if all(library.is_byte(i) for i in byte_ids) else [], library.unk_id(), rule, _is_plain(model))
    for piece, z in symbols.items():
        for k in range(1, len(piece)):
            a, b = symbols.get(piece[:k]), symbols.get(piece[k:])
            if a is not None and b is not None:
                out.joined[out.key(a, b)] = z
    # Shorter pieces first, so that the parts of a last merge are known.  A piece that its own characters
    # do not merge into is never a token.
    for piece in sorted(symbols, key=len):
        z = symbols[piece]
        if len(piece) == 1:
            time[z] = 0.0
            continue
        left, parts = out.simulate([symbols[c] for c in piece])
        if left != [z] or parts is None:
            out.odd.add(z)
            continue
        out.split[z] = parts
        if any(p in out.odd or time[p] >= time[z] for p in parts):
            out.odd.add(z)
    return out


def _is_plain(model: bytes) -> bool:
    """Whether normalisation only puts a blank before the text and a sign for each space."""
    try:
        from sentencepiece import sentencepiece_model_pb2
    except ImportError:  # its parser is an extra: the library's normaliser then does it
        return False
    said = sentencepiece_model_pb2.ModelProto.FromString(model)
    rule = said.normalizer_spec
    return rule.add_dummy_prefix and rule.escape_whitespaces and not (rule.precompiled_charsmap or rule.remove_extra_whitespaces or said.trainer_spec.treat_whitespace_as_suffix)


def _library(model: bytes):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_proto=model)


class Lookup:
    """A growing table from int64 keys to int32 values with open addressing, read many keys at once."""

    def __init__(self, bits: int = 12):
        self.bits, self.n = bits, 0
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int32)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The value of each key, -1 if it has none."""
        at = self._slots(keys)
        found = self.keys[at]
        out = np.where(found == keys, self.values[at], np.int32(-1))
        rest = np.flatnonzero((found != keys) & (found != -1))
        while len(rest):
            at[rest] = (at[rest] + 1) & ((1 << self.bits) - 1)
            found = self.keys[at[rest]]
            hit = found == keys[rest]
            out[rest[hit]] = self.values[at[rest[hit]]]
            rest = rest[~hit & (found != -1)]
        return out

    def put(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Adds keys that are distinct and new."""
        if 4 * (self.n + len(keys)) > 1 << self.bits:
            mine = self.keys >= 0
            keys, values = np.r_[self.keys[mine], keys], np.r_[self.values[mine], values]
            self.__init__(int(4 * len(keys)).bit_length())
        self.n += len(keys)
        at = self._slots(keys)
        while len(keys):
            free = self.keys[at] == -1
            self.keys[at[free]] = keys[free]  # of several for one slot the last one gets it
            self.values[at[free]] = values[free]
            left = self.keys[at] != keys
            keys, values, at = keys[left], values[left], (at[left] + 1) & ((1 << self.bits) - 1)


class Encoder:
    """Encodes normalised texts with a model's tables; remembers the chunks of the texts it has seen."""

    def __init__(self, tables: Merges):
        self.tables = tables
        self.chunks = _RULES[tables.rule].findall
        self.length = np.zeros(len(tables.time), np.int64)
        for piece, z in tables.symbols.items():
            self.length[z] = len(piece)
        # The automaton: a tree of the pieces; self.token has the piece that ends at a node.
        nodes: dict[tuple[int, str], int] = {}
        token = [-1]
        for piece, z in tables.symbols.items():
            if len(piece) == 1 or z in tables.split:
                node = 0
                for c in piece:
                    node = nodes.setdefault((node, c), len(token))
                    if node == len(token):
                        token.append(-1)
                token[node] = z
        self.token = np.array(token, np.int32)
        self.edges, self.pairs = Lookup(), Lookup()
        self.edges.put(np.array([n << 21 | ord(c) for n, c in nodes], np.int64), np.array(list(nodes.values()), np.int32))
        self.gap = next(c for c in map(chr, range(1, 0x110000)) if c not in tables.symbols)
        self.young: dict[str, tuple[int, ...]] = {}
        self.old: dict[str, tuple[int, ...]] = {}

    def matches(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, token) of every piece that stands in the text: all places walk the tree at once."""
        found = []
        start, node, depth = np.arange(len(codes)), np.zeros(len(codes), np.int64), 0
        while len(start):
            node = self.edges.get(node << 21 | codes[start + depth]).astype(np.int64)
            depth += 1
            on = np.flatnonzero(node >= 0)
            start, node = start[on], node[on]
            token = self.token[node]
            here = np.flatnonzero(token >= 0)
            found.append((start[here], start[here] + depth, token[here]))
            more = start + depth < len(codes)
            start, node = start[more], node[more]
        return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 3

    def fits(self, before: np.ndarray, token: np.ndarray) -> np.ndarray:
        """Whether each token may follow the one before it; anything may follow none (-1)."""
        key = np.where(before < 0, np.int64(0), before.astype(np.int64) << 24 | token)
        known = self.pairs.get(key)
        known[before < 0] = 1
        open_ = np.flatnonzero(known < 0)
        if len(open_):
            if self.pairs.n >= KEPT_PAIRS:
                self.pairs = Lookup()
            new = np.unique(key[open_])
            tested = np.array([self.tables.compatible(k >> 24, k & 0xFFFFFF) for k in new.tolist()], np.int32)
            known[open_] = tested[np.searchsorted(new, key[open_])]
            fresh = self.pairs.get(new) < 0
            self.pairs.put(new[fresh], tested[fresh])
        return known == 1

    def last_tokens(self, codes: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """For each prefix of each chunk its last token, -1 for a character outside the vocabulary, which
        merges with nothing.  Chunks begin at ``begin``, a foreign character before each: their prefixes
        of one length are settled together, those of long chunks one by one."""
        start, end, token = self.matches(codes)
        last = np.full(len(codes) + 1, -1, np.int32)
        chunk = np.searchsorted(begin, start, "right") - 1
        long = np.diff(np.r_[begin, len(codes) + 1])[chunk] > KEPT_LENGTH + 1
        level = np.where(long, KEPT_LENGTH + 1, np.minimum(end - begin[chunk], KEPT_LENGTH + 1)).astype(np.int16)
        order = np.argsort(level, kind="stable")
        start, end, token, level = start[order], end[order], token[order], level[order]
        cuts = np.searchsorted(level, np.arange(KEPT_LENGTH + 3))
        for low, high in zip(cuts[:-2], cuts[1:-1]):
            if high > low:
                ok = self.fits(last[start[low:high]], token[low:high])
                last[end[low:high][ok]] = token[low:high][ok]
        tail = slice(int(cuts[-2]), len(start))
        if tail.start < tail.stop:
            self._one_by_one(last, start[tail], end[tail], token[tail])
        return last

    def _one_by_one(self, table: np.ndarray, start: np.ndarray, end: np.ndarray, token: np.ndarray) -> None:
        order = np.argsort(end, kind="stable")
        last, known = table.tolist(), {}
        for s, e, t in zip(start[order].tolist(), end[order].tolist(), token[order].tolist()):
            if last[e] < 0:
                pair = last[s], t
                if last[s] >= 0 and pair not in known:
                    known[pair] = self.tables.compatible(*pair)
                if last[s] < 0 or known[pair]:
                    last[e] = t
        table[:] = last

    def _bytes(self, c: str) -> list[int]:
        return [self.tables.byte_ids[b] for b in c.encode()] if self.tables.byte_ids else [self.tables.unknown]

    def recovered(self, chunk: str, last: list[int]) -> tuple[int, ...]:
        """The ids of a chunk, read off its prefixes' last tokens from its end."""
        out: list[int] = []
        at = len(chunk)
        while at:
            token = last[at]
            if 0 <= token < self.tables.n_pieces:
                out.append(token)
                at -= int(self.length[token])
            else:
                out.extend(reversed(self._bytes(chunk[at - 1])))
                at -= 1
        if not self.tables.byte_ids:  # neighbouring unknown characters are one token
            out = [x for x, y in zip(out, [None, *out]) if x != self.tables.unknown or y != x]
        return tuple(reversed(out))

    def encoded(self, chunks: list[str]) -> list[tuple[int, ...]]:
        """The ids of each chunk, by one table over all of them with a foreign character before each."""
        if not chunks:
            return []
        codes = np.frombuffer((self.gap + self.gap.join(chunks)).encode("utf-32-le"), np.uint32).astype(np.int64)
        size = np.array([len(c) for c in chunks], np.int64)
        begin = 1 + np.cumsum(size + 1) - (size + 1)
        last = self.last_tokens(codes, begin)
        foreign = np.zeros(len(last), bool)  # prefixes whose last character is no token of its own
        foreign[1:] = (last[1:] < 0) | (last[1:] >= self.tables.n_pieces)
        foreign[begin] = False
        by_hand = np.add.reduceat(foreign, begin) > 0
        row, at = np.flatnonzero(~by_hand), (begin + size)[~by_hand]
        rounds = []
        while len(row):
            token = last[at]
            rounds.append((row, token))
            at = at - self.length[token]
            on = at > begin[row]
            row, at = row[on], at[on]
        rows = np.concatenate([r for r, _ in reversed(rounds)]) if rounds else np.zeros(0, np.int64)
        ids = np.concatenate([t for _, t in reversed(rounds)]) if rounds else np.zeros(0, np.int32)
        order = np.argsort(rows, kind="stable")
        cut = np.searchsorted(rows[order], np.arange(len(chunks) + 1)).tolist()
        flat = ids[order].tolist()
        out = [tuple(flat[a:b]) for a, b in zip(cut, cut[1:])]
        for i in np.flatnonzero(by_hand).tolist():
            out[i] = self.recovered(chunks[i], last[begin[i] : begin[i] + size[i] + 1].tolist())
        return out

    def parts(self, text: str) -> Iterator[str]:
        """A long text in parts, cut before a blank that follows another character."""
        low = 0
        while self.tables.rule == 0 and len(text) - low > PART_CHARS:
            cut = _NEXT_BLANK.search(text, low + PART_CHARS)
            if cut is None:
                break
            yield text[low : cut.start()]
            low = cut.start()
        yield text[low:] if low else text

    def encode(self, texts: list[str]) -> list[list[int]]:
        """The ids of each text; the chunks that are new among all of them are encoded together."""
        out: list[list[int]] = [[] for _ in texts]
        held: list[tuple[int, list[str]]] = []
        room = BLOCK_CHARS

        def flush() -> None:
            if len(self.young) >= KEPT_CHUNKS:
                self.young, self.old = {}, self.young
            young, old = self.young, self.old
            new = set(chain.from_iterable(chunks for _, chunks in held)).difference(young)
            young.update((c, old[c]) for c in new if c in old)
            missing = [c for c in new if c not in old]
            young.update(zip(missing, self.encoded(missing)))
            for i, chunks in held:
                out[i].extend(chain.from_iterable(map(young.__getitem__, chunks)))
            for c in missing:
                if len(c) > KEPT_LENGTH:
                    del young[c]
            held.clear()

        for i, text in enumerate(texts):
            for part in self.parts(text) if text else ():
                held.append((i, self.chunks(part)))
                room -= len(part)
                if room <= 0:
                    flush()
                    room = BLOCK_CHARS
        flush()
        return out


_loaded: dict[str, tuple[object, Encoder]] = {}


def _tools(sent) -> tuple[object, Encoder]:
    """The library's model and the encoder, kept by the worker for the tasks that follow."""
    name, model, tables = sent.value
    if name not in _loaded:
        _loaded.clear()
        _loaded[name] = _library(model), Encoder(tables)
    return _loaded[name]


def _sent(docs: DataFrame, model_path: str):
    import hashlib

    with open(model_path, "rb") as f:
        model = f.read()
    return docs.sparkSession.sparkContext.broadcast((hashlib.sha256(model).hexdigest(), model, merges(model)))


def _lists(ids: list[list[int]]) -> pa.Array:
    at = np.zeros(len(ids) + 1, np.int32)
    np.cumsum([len(x) for x in ids], out=at[1:])
    return pa.ListArray.from_arrays(pa.array(at), pa.array(np.fromiter(chain.from_iterable(ids), np.int32, int(at[-1]))))


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """One row per row of ``docs``: id, ids (array<int>), without begin and end ids; with ``decoded`` also
    decoded, the text that the library makes of the ids.

    A null text counts as empty (no ids, empty text); a null id stays null; repeated rows give repeated
    results; other columns are not read.  Normalisation is the library's; characters outside the
    vocabulary become byte ids (the unknown id in models without them).  The model file is read on the
    driver, and it and the tables made of it, of the vocabulary's size, are broadcast.  No shuffle: each
    scan task encodes its rows in blocks of two megabytes, so its memory follows the longest text; a
    text without blanks takes time linear in its length.
    """
    sent = _sent(docs, model_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library, encoder = _tools(sent)
        for batch in batches:
            for low, high in kernel.blocks(batch.column(1), BLOCK_BYTES):
                texts = [x or "" for x in batch.column(1).slice(low, high - low).to_pylist()]
                ids = encoder.encode([x and (BLANK + x.replace(" ", BLANK) if encoder.tables.plain else library.normalize(x)) for x in texts])
                columns = [batch.column(0).slice(low, high - low), _lists(ids)]
                names = [id_col, "ids"]
                if decoded:
                    columns.append(pa.array(library.decode(ids), pa.string()))
                    names.append("decoded")
                yield pa.RecordBatch.from_arrays(columns, names)

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>" + (", decoded string" if decoded else ""))


def decode(rows: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, decoded): the library's text of each list of ids; a null list counts as empty.  A null or an
    id outside the vocabulary inside a list is an unknown token."""
    sent = _sent(rows, model_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library, encoder = _tools(sent)
        n, unknown = encoder.tables.n_pieces, encoder.tables.unknown
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                ids = [[i if i is not None and 0 <= i < n else unknown for i in x or []] for x in batch.column(1).slice(low, 256).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, 256), pa.array(library.decode(ids), pa.string())], [id_col, "decoded"])

    kind = rows.schema[id_col].dataType.simpleString()
    return rows.select(id_col, ids_col).mapInArrow(run, f"`{id_col}` {kind}, decoded string")
