"""A byte-pair vocabulary compiled to a tokenization automaton, and an encoder of whole Arrow batches around it.

The automaton reads tokens. It starts as one state with an arc for each base symbol, and every merge
``(a, b)`` is applied in turn as a gadget: ``b`` is cut from the state that ``a`` leads to, and an arc
``ab`` is added wherever ``a`` leaves. All arcs of one label keep leading to one state, and the state
after ``ab`` starts as the state after ``b`` was at that moment, so later cuts of ``b`` reach only the states
made after them. Numbered by a walk through these inheritances, latest first, the states that a gadget's
cut reaches are one run of numbers, and so are the arcs: a gadget clears a rectangle of the transition table.

Compiling gives integer tables: the spelling of arcs (a trie of base symbols), the row of each state, the
column of each arc and a bit for each row and column. Every word has exactly one accepted path, and that
path is its byte-pair encoding; words are driven through the tables in lock-step, one symbol at a time.
"""

from __future__ import annotations

import gc
import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from tokenizers import Tokenizer

from .words import Words, gather

_NEVER = 1 << 60


class _Gadgets:
    """The merges of a model, applied one by one."""

    def __init__(self, vocab: dict[str, int], merges: list):
        self.left: dict[int, int] = {}
        self.right: dict[int, int] = {}
        self.born: dict[int, int] = dict.fromkeys(vocab.values(), -1)
        self.cut: dict[tuple[int, int], int] = {}
        for step, merge in enumerate(merges):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            i, j, k = vocab[a], vocab[b], vocab[a + b]
            if k in self.left or not self.open(i, j):
                continue  # no path has a before b any more: the gadget would add arcs that nothing reaches
            self.left[k], self.right[k], self.born[k] = i, j, step
            self.cut[i, j] = step

    def open(self, x: int, y: int) -> bool:
        """Whether the state after x has an arc y now, told from the cuts made while parts of x and y stood for them."""
        born, cut = self.born, self.cut
        end_x = end_y = _NEVER
        while True:
            step = cut.get((x, y))
            if step is not None and step < end_x and step <= end_y:
                return False
            bx, by = born[x], born[y]
            if bx < 0 and by < 0:
                return True
            if bx >= by:
                end_x, after = bx, self.right[x]
            else:
                after = x
            if by >= bx:
                end_y, y = by, self.left[y]
            x = after

    def walk(self, heir_of: dict[int, int]) -> tuple[np.ndarray, np.ndarray, dict[int, list[int]]]:
        """(number, end of the run of heirs, heirs of each, latest first) of all tokens, where ``heir_of`` tells whom a token follows."""
        heirs: dict[int, list[int]] = {}
        for x in sorted(self.born, key=self.born.get, reverse=True):
            heirs.setdefault(heir_of.get(x, -1), []).append(x)
        number, end = (np.zeros(max(self.born) + 1, np.int64) for _ in range(2))
        at, stack = 0, [(x, False) for x in reversed(heirs.get(-1, []))]
        while stack:
            x, left = stack.pop()
            if left:
                end[x] = at
            else:
                number[x], at = at, at + 1
                stack.append((x, True))
                stack.extend((k, False) for k in reversed(heirs.get(x, ())))
        return number, end, heirs

    def reach(self, x: int, step: int, end: np.ndarray, number: np.ndarray, heirs: dict[int, list[int]]) -> tuple[int, int]:
        """The run of x and of its heirs made after a step."""
        own = heirs.get(x, ())
        low, high = 0, len(own)
        while low < high:
            mid = (low + high) // 2
            low, high = (mid + 1, high) if self.born[own[mid]] > step else (low, mid)
        return int(number[x]), int(end[own[low - 1]]) if low else int(number[x]) + 1


class TokenAutomaton:
    """Integer tables of the automaton of one tokenizer file with a ``BPE`` model."""

    def __init__(self, spec: str):
        model = json.loads(spec)["model"]
        if model["type"] != "BPE" or model.get("continuing_subword_prefix") or model.get("unk_token"):
            raise ValueError("only plain BPE models with an optional end-of-word suffix are supported")
        vocab, suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        gadgets = _Gadgets(vocab, model["merges"])
        self._arcs(gadgets)
        self._spelling(vocab, suffix, gadgets.left)

    def _arcs(self, g: _Gadgets) -> None:
        states, arcs = g.walk(g.right), g.walk(g.left)
        cleared = np.zeros((len(g.cut), 4), np.int64)
        for k, ((a, b), step) in enumerate(g.cut.items()):
            # an arc made by the same step begins with b only where a is b, and a before ab is cut as well
            cleared[k] = *g.reach(a, step, states[1], states[0], states[2]), *g.reach(b, step - 1, arcs[1], arcs[0], arcs[2])
        rows, columns = np.unique(cleared[:, :2]), np.unique(cleared[:, 2:])  # states between two borders have the same arcs
        self.row = np.searchsorted(rows, states[0], side="right").astype(np.int32)
        self.column = np.searchsorted(columns, arcs[0], side="right").astype(np.int32)
        x, y = np.searchsorted(rows, cleared[:, :2]) + 1, np.searchsorted(columns, cleared[:, 2:]) + 1
        table = np.zeros((len(rows) + 1, len(columns) + 1), bool)
        for (x0, x1), (y0, y1) in zip(x.tolist(), y.tolist(), strict=True):
            table[x0:x1, y0:y1] = True
        self.closed = np.packbits(table, axis=1, bitorder="little")

    def _spelling(self, vocab: dict[str, int], suffix: str, made: dict[int, int]) -> None:
        spelled = {i: label.removesuffix(suffix) if suffix else label for label, i in vocab.items()}
        points = sorted({ord(s) for s in spelled.values() if len(s) == 1})
        self.points = np.array(points, np.uint32)
        place = {chr(p): i for i, p in enumerate(points)}
        self.final = len(points) if suffix else 0  # a last symbol has this added
        self.symbols = 2 * len(points) + 1
        plain = np.full(self.symbols, -1, np.int64)
        goto: dict[int, int] = {}
        token = [-1]
        for label, i in vocab.items():
            own = spelled[i]
            if i not in made and len(own) != 1:
                continue  # a token that no path uses
            node = 0
            path = [place[s] for s in own]
            if suffix and label.endswith(suffix) and label != own:
                path[-1] += self.final
            for s in path:
                key = node * self.symbols + s
                node = goto.get(key, 0)
                if not node:
                    node = goto[key] = len(token)
                    token.append(-1)
            token[node] = i
            if len(path) == 1:
                plain[path[0]] = i
        self.known = plain >= 0
        keys = np.fromiter(goto, np.int64, len(goto))
        order = np.argsort(keys)
        self.keys, self.children = keys[order], np.fromiter(goto.values(), np.int64, len(goto))[order].astype(np.int32)
        self.token = np.array(token, np.int32)

    def arc(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether the states after tokens x have arcs y."""
        column = self.column[y]
        return (self.closed[self.row[x], column >> 3] >> (column & 7).astype(np.uint8) & 1) == 0

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, number of ids of each), in time proportional to their symbols. A symbol that the vocabulary lacks is left out."""
        points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        at = np.minimum(np.searchsorted(self.points, points), max(len(self.points) - 1, 0)) if len(self.points) else np.zeros(len(points), np.int64)
        symbol = np.where(self.points[at] == points, at, self.symbols - 1) if len(self.points) else np.full(len(points), self.symbols - 1)
        ends = np.cumsum(lengths)
        last_of = ends[lengths > 0] - 1
        symbol[last_of] = np.where(symbol[last_of] < self.symbols - 1, symbol[last_of] + self.final, self.symbols - 1)
        real = self.known[symbol]
        if not real.all():
            ends = np.concatenate([[0], np.cumsum(real)])[ends]
            symbol = symbol[real]
            lengths = np.diff(ends, prepend=0)
        last, begin = self._drive(symbol, ends - lengths, lengths)
        used = np.zeros(len(symbol), bool)
        place = ends[lengths > 0] - 1
        first = (ends - lengths)[lengths > 0]
        while len(place):
            used[place] = True
            place = begin[place] - 1
            more = place >= first
            place, first = place[more], first[more]
        return last[used], np.diff(np.concatenate([[0], np.cumsum(used)])[ends], prepend=0)

    def _drive(self, symbol: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each symbol, the arc by which the accepted path of its word up to there ends, and where that arc begins."""
        last, begin = np.full(len(symbol), -1, np.int32), np.zeros(len(symbol), np.int64)
        order = np.argsort(-lengths, kind="stable")
        starts, lengths = starts[order], lengths[order]
        longer = np.searchsorted(-lengths, -np.arange(int(lengths[0]) + 1 if len(lengths) else 0), side="left")  # words with more than i symbols
        node = word = np.zeros(0, np.int64)  # partly spelled arcs, with where they begin and the rank of their word
        since = np.zeros(0, np.int64)
        for i in range(int(lengths[0]) if len(lengths) else 0):
            n = longer[i]
            live = word < n
            word = np.concatenate([word[live], np.arange(n)])
            since = np.concatenate([since[live], starts[:n] + i])
            node = np.concatenate([node[live], np.zeros(n, np.int64)])
            place = starts[word] + i
            key = node * self.symbols + symbol[place]
            at = np.searchsorted(self.keys, key)
            at[at == len(self.keys)] = 0
            hit = np.flatnonzero(self.keys[at] == key)
            word, since, place, node = word[hit], since[hit], place[hit], self.children[at[hit]].astype(np.int64)
            whole = np.flatnonzero(self.token[node] >= 0)
            arc, own, since_whole = self.token[node[whole]], place[whole], since[whole]
            inner = since_whole > own - i
            accepted = ~inner
            accepted[inner] = self.arc(last[since_whole[inner] - 1], arc[inner])
            last[own[accepted]], begin[own[accepted]] = arc[accepted], since_whole[accepted]
        return last, begin


def _byte_symbols() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: itself, or the next free code point from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class _Memory:
    """Pieces and their ids in flat arrays: some 40 bytes for a piece, found many at a time."""

    def __init__(self):
        self.pieces = pa.array([], pa.string())
        self.ids = np.zeros(0, "<u4")
        self.starts = self.lengths = np.zeros(0, np.int64)

    def __len__(self) -> int:
        return len(self.pieces)

    def find(self, pieces: pa.StringArray) -> np.ndarray:
        """The place of each piece, or -1."""
        return pc.fill_null(pc.index_in(pieces, value_set=self.pieces), -1).to_numpy(zero_copy_only=False).astype(np.int64)

    def add(self, pieces: pa.StringArray, ids: np.ndarray, lengths: np.ndarray) -> None:
        self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(lengths) - lengths])
        self.lengths = np.concatenate([self.lengths, lengths])
        self.ids = np.concatenate([self.ids, ids.astype("<u4")])
        self.pieces = pa.concat_arrays([self.pieces, pieces])


def _classes() -> np.ndarray:
    """0 for bytes that need the tokenizer's own rules, else 1 letter, 2 digit, 3 neither; bytes from 128 are letters here."""
    out = np.full(256, 3, np.uint8)
    out[: 0x21] = out[0x7F] = out[ord("'")] = 0
    out[ord("0") : ord("9") + 1] = 2
    for a, b in ("az", "AZ"):
        out[ord(a) : ord(b) + 1] = 1
    out[0x80:] = 1
    out[[0xC2, *range(0xCA, 0x100)]] = 0
    return out


class TextEncoder:
    """Ids of whole texts. Distinct white-space-free chunks are pre-split by the tokenizer file's own rules; distinct pieces are encoded once and remembered.

    ``engine`` is ``"automaton"`` or ``"library"`` (the tokenizers library encodes new pieces).
    At most ``remember`` pieces are kept, or those of one slice.
    """

    #: Rules whose split of letters, digits and marks ``_plain`` makes in bulk. Other files' chunks all go through the library's rules.
    _SIMPLE_RULES = ("'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+", ["NFC", "Replace", "Lowercase"])
    _CLASSES = _classes()

    def __init__(self, spec: str, engine: str, remember: int):
        self.tokenizer = Tokenizer.from_str(spec)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        if self._library("a b") != self._library("a") + self._library("b"):
            raise ValueError("only tokenizers that drop white space are supported")
        self.remember = remember
        self.known = _Memory()
        rules = json.loads(spec)
        self.added = {a["content"]: a["id"] for a in rules.get("added_tokens") or []}
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.automaton = TokenAutomaton(spec) if engine == "automaton" else None
        labels = {i: s for s, i in rules["model"]["vocab"].items()} | {i: s for s, i in self.added.items()}
        self.labels = pa.array([labels.get(i, "") for i in range(max(labels) + 1)], pa.string())
        try:
            self.simple = self._SIMPLE_RULES == (rules["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"], [n["type"] for n in rules["normalizer"]["normalizers"]])
        except (KeyError, TypeError):
            self.simple = False
        self.byte_level = '"ByteLevel"' in json.dumps(rules["pre_tokenizer"])
        self.symbols = _byte_symbols()
        self.bytes = {s: b for b, s in enumerate(self.symbols)}

    def _library(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _plain(self, chunks: pa.StringArray) -> tuple[np.ndarray, pa.StringArray, np.ndarray]:
        """(whether each chunk is of characters that are the same in every Unicode version, the pieces of those chunks, number of pieces of each).

        These are printable ASCII without apostrophes and the letters of U+00C0 to U+024F that lower-case within two bytes.
        """
        offsets = np.frombuffer(chunks.buffers()[1], np.int32)[chunks.offset : chunks.offset + len(chunks) + 1].astype(np.int64)
        data = np.frombuffer(chunks.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        after = np.append(data[1:], 0).astype(np.uint16)
        pairs = data.astype(np.uint16) << 8 | after
        odd = self._CLASSES[data] == 0
        odd |= np.isin(pairs, [0xC397, 0xC3B7, 0xC4B0, 0xC8BA, 0xC8BE, ord("<") << 8 | ord("|")]) | ((data == 0xC9) & (after > 0x8F))
        sums = np.concatenate([[0], np.cumsum(odd)])[offsets - offsets[0]]
        plain = np.diff(sums) == 0
        low = pc.utf8_lower(chunks.filter(pa.array(plain)))
        if not len(low):
            return plain, pa.array([], pa.string()), np.zeros(0, np.int64)
        ends = np.frombuffer(low.buffers()[1], np.int32)[low.offset : low.offset + len(low) + 1]
        data = np.frombuffer(low.buffers()[2], np.uint8)[: ends[-1]]
        kind = np.where(data >= 0x80, 1, self._CLASSES[data])
        new = np.ones(len(data), bool)
        new[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == 2)
        new[ends[:-1][np.diff(ends) > 0]] = True
        cuts = np.append(np.flatnonzero(new), len(data)).astype(np.int32)
        pieces = pa.StringArray.from_buffers(len(cuts) - 1, pa.py_buffer(cuts), low.buffers()[2])
        counts = np.diff(np.concatenate([[0], np.cumsum(new)])[ends])
        return plain, pieces, counts

    def _ruled(self, chunk: str) -> list[str]:
        """Pieces of a chunk by the tokenizer's own rules; an added token has a line end before it, which no piece holds."""
        out = []
        for part in self.split.split(chunk) if self.split else [chunk]:
            if part in self.added:
                out.append(f"\n{part}")
            elif part:
                split = [w for w, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(self.tokenizer.normalizer.normalize_str(part))]
                out += [bytes(self.bytes[c] for c in w).decode() for w in split] if self.byte_level else split
        return out

    def _mapped(self, piece: str) -> str:
        return piece if piece.isascii() and piece.isprintable() or not self.byte_level else "".join([self.symbols[b] for b in piece.encode()])

    def _new(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each) of pieces."""
        mapped = list(map(self._mapped, pieces))
        special = [k for k, p in enumerate(pieces) if p[0] == "\n"]
        if self.automaton:
            for k in special:
                mapped[k] = ""
            ids, lengths = self.automaton.encode(mapped)
            places = np.cumsum(lengths)[special]
            lengths[special] = 1
            return np.insert(ids, places, [self.added[pieces[k][1:]] for k in special]), lengths
        tokenize = self.tokenizer.model.tokenize
        lists = [[t.id for t in tokenize(m)] for m in mapped]
        for k in special:
            lists[k] = [self.added[pieces[k][1:]]]
        return np.array([i for x in lists for i in x], np.uint32), np.fromiter(map(len, lists), np.int64, len(lists))

    def _pieces(self, chunks: pa.StringArray) -> tuple[pa.StringArray, np.ndarray, np.ndarray]:
        """(pieces, number of pieces of each chunk, place of each chunk): plain chunks come first."""
        if self.simple:
            plain, pieces, counts = self._plain(chunks)
        else:
            plain, pieces, counts = np.zeros(len(chunks), bool), pa.array([], pa.string()), np.zeros(0, np.int64)
        place = np.empty(len(chunks), np.int64)
        place[plain] = np.arange(len(counts))
        place[~plain] = len(counts) + np.arange(len(chunks) - len(counts))
        if len(counts) < len(chunks):
            ruled = [self._ruled(c) for c in chunks.filter(pa.array(~plain)).to_pylist()]
            pieces = pa.concat_arrays([pieces, pa.array([p for own in ruled for p in own], pa.string())])
            counts = np.concatenate([counts, np.fromiter(map(len, ruled), np.int64, len(ruled))])
        return pieces, counts, place

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and where each text's begin (and the end)."""
        words = Words(texts, lower=False)
        pieces, counts, chunk_place = self._pieces(words.dictionary)
        encoded = pieces.dictionary_encode()
        distinct = encoded.dictionary
        places = self.known.find(distinct)
        missing = np.flatnonzero(places < 0)
        if len(missing):
            if len(self.known) + len(missing) > self.remember:  # start again with this slice's pieces
                self.known = _Memory()
                missing = np.arange(len(distinct))
            new = distinct.take(pa.array(missing))
            places[missing] = len(self.known) + np.arange(len(missing))
            self.known.add(new, *self._new(new.to_pylist()))
        at = places[encoded.indices.to_numpy(zero_copy_only=False)]
        of = self.known.lengths[at]
        chunk_ids = gather(self.known.ids, self.known.starts[at], of)
        ends = np.concatenate([[0], np.cumsum(of)])[np.concatenate([[0], np.cumsum(counts)])]
        codes = chunk_place[words.codes]
        of = np.diff(ends)[codes]
        return gather(chunk_ids, ends[codes], of), np.concatenate([[0], np.cumsum(of)])[words.offsets]

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
        """Texts of runs of ids: arc labels, joined as the library joins them for a file without a decoder."""
        labels = self.labels.take(pa.array(ids.astype(np.int64)))
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), labels), " ")


#: Pieces that an encoder keeps.
REMEMBERED = 600_000

_ENCODERS: dict[tuple[str, str], TextEncoder] = {}


def forget() -> None:
    """Free what the worker's encoders remember: an idle worker would keep its room from the steps that follow. The compiled tables stay."""
    for own in _ENCODERS.values():
        own.known = _Memory()
    gc.collect()
    pa.default_memory_pool().release_unused()


def encoder(spec: str, engine: str) -> TextEncoder:
    """The encoder of a Python worker."""
    key = (engine, spec)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = TextEncoder(spec, engine, REMEMBERED)
    return _ENCODERS[key]
