"""Token counts by heap-and-linked-list byte-pair merging.

A text is cut into pieces as the tokenizer file says; the symbols of a piece
are a linked list, its adjacent pairs wait in a heap by merge rank, and the
lowest is popped and merged again and again. The number of tokens is the
number of initial symbols less the number of merges; no token ids are made.
Each worker remembers the counts of recent words and pieces, in bounded memory.

``Many`` has the same counts, of many pieces at a time: texts are cut where the classes of their bytes change, in arrays, pieces
are told apart by Arrow's dictionaries, and heaps give way to tables of merge ranks, where a round merges the lowest pair of
every piece.

Edge cases. Null and empty texts have no tokens. Special strings inside a
text are one token each, as is the library's default. Texts are taken whole,
whatever their length, and a piece of any length takes n log n steps. Repeated rows and rows
without an id are counted each; an empty table gives an empty result. Extra columns are
ignored, also those with names of the result.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import prepare, table

#: The cut of the byte-level pre-tokenizer; a fixed value of the format.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A space after white space or at the start: pieces then depend on what is before the space.
WIDE = re.compile(r"(?:\s|\A) ").search
#: Pieces (and as many words) that a worker remembers, and the longest one it does.
REMEMBERED, LONGEST, LIMIT = 200_000, 64, 512
TOKENIZER = "byte_bpe_50k.json"
#: Of ``Many``: bytes of the texts that are looked at together, words and pieces that are remembered, and pieces that are merged at once.
TEXTS, KEPT, PIECES_AT_ONCE = 1 << 22, 100_000, 1 << 13
#: ASCII characters that are neither letters nor digits nor white space: after a word, a run of them is one piece.
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: The rank of a pair that does not merge.
NEVER = (1 << 31) - 1
#: Classes of characters, whose runs are pieces, and how the cut tells them.
OTHER, LETTER, DIGIT, SPACE, UNKNOWN = range(5)
KINDS = ((LETTER, regex.compile(r"\p{L}")), (DIGIT, regex.compile(r"\p{N}")), (SPACE, regex.compile(r"\s")))


def byte_names() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b if b in plain else next(others)) for b in range(256)]


class Remembered(dict):
    """The values of a function of strings, worked out once for those that are not long, in bounded memory.

    When it is full, it becomes the older of two halves; what is asked for again comes back from there.
    """

    def __init__(self, work: Callable[[str], int], most: int = REMEMBERED) -> None:
        self.work, self.most, self.older = work, most, {}

    def __missing__(self, key: str) -> int:
        n = self.older.get(key)
        if n is None:
            n = self.work(key)
            if len(key) > LONGEST:
                return n
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        self[key] = n
        return n


class Counter:
    """Counts the tokens of texts under a byte-level BPE file."""

    def __init__(self, definition: str) -> None:
        spec = json.loads(definition)
        pre = spec.get("pre_tokenizer") or {}
        if spec["model"]["type"] != "BPE" or pre.get("type") != "ByteLevel" or spec.get("normalizer") or pre.get("add_prefix_space") or not pre.get("use_regex", True):
            raise ValueError("only byte-level BPE files without normalizer and prefix space are known")
        names = byte_names()
        number: dict[str, int] = {c: i for i, c in enumerate(names)}
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        for a, b in pairs:
            for symbol in (a, b, a + b):
                number.setdefault(symbol, len(number))
        #: Ranks by pair, as one number, and the symbol that each rank makes.
        self.size = len(number)
        self.ranks = {number[a] * self.size + number[b]: rank for rank, (a, b) in enumerate(pairs)}
        self.made = [number[a + b] for a, b in pairs]
        self.specials = sorted((t["content"] for t in spec.get("added_tokens") or []), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, self.specials))) if self.specials else None
        self.find = regex.compile(PIECES).findall
        #: Counts of pieces, and of words after a space.
        self.pieces, self.words = Remembered(self.piece), Remembered(self.word)

    def word(self, word: str) -> int:
        """Tokens of a word with the space before it."""
        if word.isalpha() and max(word) < "\u0250":  # letters of which all that know Unicode say so: one piece
            return self.piece(" " + word)
        own = self.find(" " + word)
        if len(own) == 1:
            return self.piece(own[0])
        return sum(self.words[p[1:]] if p[0] == " " and len(p) > 1 else self.pieces[p] for p in own)

    def piece(self, text: str) -> int:
        """Tokens of one piece."""
        symbols = list(text.encode())
        n, size, rank, made = len(symbols), self.size, self.ranks.get, self.made
        # a heap entry is a rank and a place in one number
        bits, heap = n.bit_length(), []
        place, left = (1 << bits) - 1, symbols[0]
        for i in range(1, n):
            right = symbols[i]
            if (r := rank(left * size + right)) is not None:
                heap.append(r << bits | i - 1)
            left = right
        heapify(heap)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        done = 0
        while heap:
            entry = heappop(heap)
            i, r = entry & place, entry >> bits
            j = after[i]
            # a pair that has changed since it was pushed has another rank, or none
            if j >= n or rank(symbols[i] * size + symbols[j]) != r:
                continue
            symbols[i] = new = made[r]
            symbols[j] = -1
            done += 1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (s := rank(new * size + symbols[k])) is not None:
                    heappush(heap, s << bits | i)
            h = before[i]
            if h >= 0 and (s := rank(symbols[h] * size + new)) is not None:
                heappush(heap, s << bits | h)
        return n - done

    def texts(self, texts: pa.Array) -> list[int]:
        """Tokens of each of many texts."""
        return [self.text(t.as_py()) for t in texts]

    def text(self, text: str | None) -> int:
        """Tokens of a whole text."""
        if not text:
            return 0
        if self.special and self.special.search(text):
            return len(self.special.findall(text)) + sum(map(self.plain, self.special.split(text)))
        return self.plain(text)

    def plain(self, text: str) -> int:
        """Tokens of a text without special strings.

        A space that follows a character other than white space begins a piece, so a text is
        the sum of what stands between such spaces, and the same words come again and again.
        """
        if not text:
            return 0
        if WIDE(text):
            return sum(map(self.pieces.__getitem__, self.find(text)))
        first, *others = text.split(" ")
        return sum(map(self.pieces.__getitem__, self.find(first))) + sum(map(self.words.__getitem__, others))


class Ranks:
    """Merge ranks by pair, as a hash table in arrays."""

    def __init__(self, ranks: dict[int, int]) -> None:
        keys, self.shift = np.fromiter(ranks, np.int64, len(ranks)), 64 - max(8, len(ranks).bit_length() + 2)
        self.mask = (1 << (64 - self.shift)) - 1
        self.keys, self.ranks = np.full(self.mask + 1, -1, np.int64), np.full(self.mask + 1, NEVER, np.int32)
        values, at = np.fromiter(ranks.values(), np.int64, len(ranks)), self.first(keys)
        while len(keys):
            free = np.flatnonzero(self.keys[at] < 0)
            self.keys[at[free]] = keys[free]  # of several for one slot, one stays
            own = self.keys[at] == keys
            self.ranks[at[own]] = values[own]
            keys, values, at = keys[~own], values[~own], (at[~own] + 1) & self.mask

    def first(self, keys: np.ndarray) -> np.ndarray:
        """The slot at which the search for a key begins."""
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(self.shift)).astype(np.int64)

    def of(self, keys: np.ndarray) -> np.ndarray:
        """The rank of each pair; ``NEVER`` if it does not merge."""
        at = self.first(keys)
        there, out = self.keys[at], self.ranks[at]
        left = np.flatnonzero((there != keys) & (there >= 0))
        out[there != keys] = NEVER
        while len(left):
            at[left] = (at[left] + 1) & self.mask
            there = self.keys[at[left]]
            found = there == keys[left]
            out[left[found]] = self.ranks[at[left[found]]]
            left = left[~found & (there >= 0)]
        return out


def kinds(text: str) -> np.ndarray:
    """The class of each character."""
    out = np.full(len(text), OTHER, np.uint8)
    for kind, known in KINDS:
        out[[m.start() for m in known.finditer(text)]] = kind
    return out


class Many(Counter):
    """Counts the tokens of many texts at a time: texts are cut, and pieces that are not remembered are merged, in arrays."""

    def __init__(self, definition: str) -> None:
        super().__init__(definition)
        self.pieces, self.words = Remembered(self.piece, KEPT), Remembered(self.word, KEPT)
        #: Counts of the words of recent texts, with the space before each.
        self.known: dict[str, int] = {}
        self.table, self.symbols = Ranks(self.ranks), np.array(self.made, np.int64)
        every = np.arange(1 << 16)
        #: Ranks of pairs of bytes.
        self.bytes = self.table.of((every >> 8) * self.size + (every & 255))
        #: Recent pieces and their counts, and the classes of characters that were met.
        self.held, self.counts = pa.array([], pa.binary()), np.empty(0, np.int64)
        self.kinds = np.full(0x110000, UNKNOWN, np.uint8)
        self.kinds[:128] = kinds("".join(map(chr, range(128))))

    def texts(self, texts: pa.Array) -> list[int]:
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        out, special = np.zeros(len(texts), np.int64), np.zeros(len(texts), bool)
        for s in self.specials:
            special |= pc.match_substring(texts, s).to_numpy(zero_copy_only=False)
        if special.any():
            for i in np.flatnonzero(special).tolist():
                text = texts[i].as_py()
                out[i] = len(self.special.findall(text)) + sum(self.together(self.special.split(text)))
            texts = pc.if_else(pa.array(special), "", texts)
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else [0]
        data = np.frombuffer(texts.buffers()[2], np.uint8) if offsets[-1] else None
        lo = 0
        while lo < len(texts):
            hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + TEXTS, "right")) - 1)
            if offsets[hi] > offsets[lo]:
                out[lo:hi] += self.block(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            lo = hi
        return out.tolist()

    def block(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Tokens of each of the texts that stand one after the other in ``data``, without special strings."""
        at = self.cut(data, offsets[:-1][offsets[1:] > offsets[:-1]])
        bounds = np.append(at, len(data)).astype(np.int32)
        told = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(bounds), pa.py_buffer(data)]).dictionary_encode()
        total = np.concatenate([[0], np.cumsum(self.distinct(told.dictionary)[told.indices.to_numpy()])])
        return np.diff(total[np.searchsorted(at, offsets)])

    def cut(self, data: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """Where each piece begins. ``begins`` has the first byte of each text; all bytes of a character are of its class."""
        n, kind = len(data), self.kinds[data]
        first = np.zeros(n, bool)
        first[begins] = True
        wide = np.flatnonzero(data > 127)
        points = np.frombuffer(data[wide].tobytes().decode().encode("utf-32-le"), np.uint32)
        own = self.kinds[points]
        if (own == UNKNOWN).any():
            new = np.unique(points[own == UNKNOWN])
            self.kinds[new] = kinds("".join(map(chr, new.tolist())))
            own = self.kinds[points]
        size = 2 + (points >= 0x800) + (points >= 0x10000)
        kind[wide] = np.repeat(own, size)
        # a class begins, other than after a space, which belongs to what follows
        start = np.ones(n, bool)
        start[1:] = (kind[1:] != kind[:-1]) & (data[:-1] != 0x20)
        # the last white space before something else is no part of the run before it
        white = kind == SPACE
        start[1:-1] |= white[1:-1] & ~white[2:] & ~first[2:]
        spaces = np.flatnonzero(own == SPACE)
        if len(spaces):
            last = wide[np.cumsum(size)[spaces] - 1]
            moved = last[start[last]] - size[spaces][start[last]] + 1
            start[last] = False
            start[moved] = True
        start[begins] = True
        # 's 't 'm 'd 're 've 'll where no run of marks is before them
        marks = np.flatnonzero((data[:-1] == 0x27) & start[:-1] & ~first[1:])
        a, b = data[marks + 1], data[np.minimum(marks + 2, n - 1)]
        pair = ((a == 0x72) | (a == 0x76)) & (b == 0x65) | (a == 0x6C) & (b == 0x6C)
        pair &= (marks + 2 < n) & ~first[np.minimum(marks + 2, n - 1)]
        short = (a == 0x73) | (a == 0x74) | (a == 0x6D) | (a == 0x64)
        start[marks[short | pair] + 1] = False
        after = np.concatenate([marks[short] + 2, marks[pair] + 3])
        start[after[after < n]] = True
        return np.flatnonzero(start)

    def distinct(self, pieces: pa.BinaryArray) -> np.ndarray:
        """Tokens of each of many different pieces; those that are not remembered are merged together."""
        where = pc.fill_null(pc.index_in(pieces, self.held), -1).to_numpy()
        new = np.flatnonzero(where < 0)
        fresh = pieces.take(pa.array(new))
        out = np.empty(len(pieces), np.int64)
        old = where >= 0
        out[old] = self.counts[where[old]]
        out[new] = counts = self.merge(fresh)
        if len(self.held) + len(fresh) > KEPT:  # the pieces of these texts stay
            self.held, self.counts, fresh, counts = self.held[:0], self.counts[:0], pieces, out
        short = pc.binary_length(fresh).to_numpy() <= LONGEST
        self.held, self.counts = pa.concat_arrays([self.held, fresh.filter(pa.array(short))]), np.concatenate([self.counts, counts[short]])
        return out

    def together(self, texts: list[str]) -> list[int]:
        """Tokens of each text. The words of all are counted first; texts that are not cut at single spaces are counted as before."""
        cut = [None if not t or WIDE(t) or (self.special and self.special.search(t)) else t.split(" ") for t in texts]
        words = set().union(*(w[1:] for w in cut if w))
        self.learn(words)
        known = self.known.__getitem__
        out = [self.text(t) if w is None else sum(map(self.pieces.__getitem__, self.find(w[0]))) + sum(map(known, w[1:])) for t, w in zip(texts, cut, strict=True)]
        if len(self.known) > KEPT:  # the words of these texts stay
            self.known = {w: self.known[w] for w in words if len(w) <= LONGEST}
        return out

    def learn(self, words: set[str]) -> None:
        """Counts the tokens of each word, with the space before it, that is not known."""
        new, whole, marked, parts = words.difference(self.known), [], [], []
        for w in new:
            if w.isalpha() and (w.isascii() or max(w) < "\u0250"):  # as in ``word``
                whole.append(w)
                continue
            core = w.rstrip(MARKS)
            if core != w and core.isascii() and core.isalpha():
                marked.append((w, core))
            elif len(own := self.find(" " + w)) == 1:
                whole.append(w)
            else:
                parts.append((w, own))
        begun = {core for _, core in marked}
        begun |= {p[1:] for _, own in parts for p in own if p[0] == " " and len(p) > 1}
        whole += begun.difference(new, self.known)
        self.known.update(zip(whole, self.merged([" " + w for w in whole]), strict=True))
        for w, core in marked:
            self.known[w] = self.known[core] + self.pieces[w[len(core) :]]
        for w, own in parts:
            self.known[w] = sum(self.known[p[1:]] if p[0] == " " and len(p) > 1 else self.pieces[p] for p in own)

    def merged(self, pieces: list[str]) -> list[int]:
        """Tokens of each of many pieces."""
        return self.merge(pa.array([p.encode() for p in pieces], pa.binary())).tolist()

    def merge(self, pieces: pa.BinaryArray) -> np.ndarray:
        """Tokens of each of many pieces. Long ones go to the heap, as rounds would be as many as merges."""
        out, lengths = np.zeros(len(pieces), np.int64), pc.binary_length(pieces).to_numpy().astype(np.int64)
        order = np.argsort(lengths, kind="stable")
        lengths = lengths[order]
        most = int(np.searchsorted(lengths, 4 * LONGEST, "right"))
        for i in order[most:].tolist():
            out[i] = self.piece(pieces[i].as_py().decode())
        if not most:
            return out
        data, ends = np.frombuffer(pieces.take(pa.array(order[:most])).buffers()[2], np.uint8), np.concatenate([[0], np.cumsum(lengths[:most])])
        lo = 0
        while lo < most:
            # pieces of a table are about as long
            hi = min(lo + PIECES_AT_ONCE, int(np.searchsorted(lengths[:most], lengths[lo] * 5 // 4 + 1, "right")))
            out[order[lo:hi]] = self.rounds(data[ends[lo] : ends[hi]], lengths[lo:hi])
            lo = hi
        return out

    def rounds(self, symbols: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Symbols that are left of each piece when no pair merges any more.

        A row of a table has the symbols of a piece, and a row of another one the ranks of their pairs, of which the lowest merges, the
        first of equal ones. All rows lose a symbol in a round; those that lose none are done and leave.
        """
        left, rows = lengths.astype(np.int64), np.arange(len(lengths))
        inside = np.arange(lengths.max()) < lengths[:, None]
        table = np.zeros(inside.shape, np.int64)
        table[inside] = symbols
        lowest = self.bytes[table[:, :-1] << 8 | table[:, 1:]]
        lowest[~inside[:, 1:]] = NEVER
        while lowest.size:
            j = lowest.argmin(1)
            best = lowest[np.arange(len(rows)), j]
            some = best < NEVER
            if not some.all():
                rows, table, lowest, j, best = rows[some], table[some], lowest[some], j[some], best[some]
            left[rows] -= 1
            n, width = table.shape
            columns, i, new = np.arange(width), np.arange(n), self.symbols[best]
            table = table[columns != j[:, None] + 1].reshape(n, width - 1)
            lowest = lowest[columns[:-1] != j[:, None]].reshape(n, width - 2)
            table[i, j] = new
            a, b = np.flatnonzero(j + 1 < left[rows]), np.flatnonzero(j > 0)
            keys = np.concatenate([new[a] * self.size + table[a, j[a] + 1], table[b, j[b] - 1] * self.size + new[b]])
            rank = self.table.of(keys)
            lowest[a, j[a]], lowest[b, j[b] - 1] = rank[: len(a)], rank[len(a) :]
            # what is behind the end of a piece never merges
            end = np.flatnonzero((j + 1 >= left[rows]) & (j < width - 2))
            lowest[end, j[end]] = NEVER
        return left


def tokenizer_file(tokenizer: str = TOKENIZER) -> str:
    """The content of a public tokenizer's file."""
    import public_tokenizers

    with open(public_tokenizers.path(tokenizer), encoding="utf-8") as f:
        return f.read()


def count_tokens(docs: DataFrame, definition: str, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text", counter: type[Counter] = Counter) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for every document; ``definition`` is the content of the tokenizer's file, ``counter`` one of the two."""
    spark = docs.sparkSession
    prepare(spark)
    sent = spark.sparkContext.broadcast(definition)  # one file, of the vocabulary's size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(sent.value)  # of this task: an executor has more workers than cores, and idle ones would keep theirs
        for batch in batches:
            counts = own.texts(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(counts, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)


def op4_heap_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every whole document."""
    return count_tokens(table(spark, sf_dir, "documents"), tokenizer_file())
