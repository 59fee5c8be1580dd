"""Problem 7: the whole corpus as ids of a public byte-level BPE tokenizer, by merge replay.

A text falls into words by the tokenizer's split pattern, and merges never cross words, so equal words have equal ids
wherever they stand. A task therefore keeps a lexicon of the distinct words of its share of the corpus. New words are
encoded together: their bytes lie in one sequence, an inverted index leads from each adjacent token pair to its
positions, and the merges are applied in rank order to all positions at once, updating only the neighbours that a merge
touches. A rank, once left, never comes back, since a merge's result takes part in later merges only.

The lexicon is per task rather than shuffled together: results are the same, and no text or word moves.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Callable, Iterable, Iterator
from functools import cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sparkquarry.sources import spread

#: Words of a task's lexicon, after which it starts anew; results don't depend on it.
LEXICON_WORDS = 300_000
#: Code points that are handled at once; a longer text is a block of its own.
BLOCK_CHARS = 400_000


def tokenizer_file(name: str = "byte_bpe_50k.json", folder: str = "/opt/tokenizers") -> str:
    return str(Path(folder) / name)


@cache
def _split_pattern():
    import regex

    # Fixed value: the split pattern of the public tokenizer.
    return regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")


def _byte_letters() -> dict[str, int]:
    """The printable stand-ins that the vocabulary file writes for bytes: printable Latin-1 is itself, the rest follows from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def read_merges(file: str) -> tuple[np.ndarray, np.ndarray]:
    """The ids of the 256 bytes; for each merge in rank order: left id, right id, id of the result."""
    model = json.loads(Path(file).read_text(encoding="utf-8"))["model"]
    vocab = model["vocab"]
    letters = np.zeros(256, np.int32)
    for letter, b in _byte_letters().items():
        letters[b] = vocab[letter]
    pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
    return letters, np.array([(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs], np.int32)


class MergeReplay:
    """Encodes many words at once."""

    def __init__(self, letters: np.ndarray, merges: np.ndarray):
        self.letters = letters
        self.merges = merges.tolist()
        self.rank = {a << 32 | b: r for r, (a, b, _) in enumerate(self.merges)}
        byte_of = {int(x): i for i, x in enumerate(letters)}
        #: The ranks of pairs of bytes, as the replay begins.
        self.first = np.full((256, 256), -1, np.int32)
        for r, (a, b, _) in enumerate(self.merges):
            if a in byte_of and b in byte_of:
                self.first[byte_of[a], byte_of[b]] = r

    def __call__(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The words' ids one after another, and the number of ids of each."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        raw = np.frombuffer(b"".join(words), np.uint8)
        n = len(raw)
        if not n:
            return np.empty(0, np.int32), sizes
        ends = np.cumsum(sizes)
        last = np.zeros(n, bool)
        last[ends[sizes > 0] - 1] = True
        ranks = np.where(last[:-1], -1, self.first[raw[:-1], raw[1:]])
        at = np.nonzero(ranks >= 0)[0]
        at = at[np.argsort(ranks[at], kind="stable")]
        keys, begin = np.unique(ranks[at], return_index=True)
        index: dict[int, list[int]] = {int(k): p.tolist() for k, p in zip(keys, np.split(at, begin[1:]))}
        following = np.arange(1, n + 1)
        following[last] = -1
        before = np.arange(-1, n - 1)
        before[1:][last[:-1]] = -1
        symbol, following, before = self.letters[raw].tolist(), following.tolist(), before.tolist()
        rank, merges, queue = self.rank.get, self.merges, list(index)
        heapq.heapify(queue)
        while queue:
            r = heapq.heappop(queue)
            a, b, c = merges[r]
            for p in sorted(index.pop(r)):
                if symbol[p] != a or (q := following[p]) < 0 or symbol[q] != b:
                    continue
                symbol[p], symbol[q] = c, -1
                following[p] = after = following[q]
                if after >= 0:
                    before[after] = p
                    if (x := rank(c << 32 | symbol[after])) is not None:
                        if x in index:
                            index[x].append(p)
                        else:
                            index[x] = [p]
                            heapq.heappush(queue, x)
                if (left := before[p]) >= 0 and (x := rank(symbol[left] << 32 | c)) is not None:
                    if x in index:
                        index[x].append(left)
                    else:
                        index[x] = [left]
                        heapq.heappush(queue, x)
        symbols = np.array(symbol, np.int32)
        alive = symbols >= 0
        upto = np.concatenate(([0], np.cumsum(alive)))
        return symbols[alive], upto[ends] - upto[ends - sizes]


class Lexicon:
    """The ids of the words seen so far by one task."""

    def __init__(self, replay: MergeReplay):
        self.replay = replay
        self.clear()

    def clear(self) -> None:
        self.place: dict[str, int] = {}
        self.values = np.empty(0, np.int32)
        self.sizes = np.empty(0, np.int64)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The texts' ids one after another, and the number of ids of each; null is as empty."""
        split = _split_pattern().findall
        words = [split(t) if t else [] for t in texts]
        counts = np.fromiter(map(len, words), np.int64, len(words))
        flat = [w for ws in words for w in ws]
        del words
        if len(self.place) > LEXICON_WORDS:
            self.clear()
        place = self.place
        new = [w for w in dict.fromkeys(flat) if w not in place]
        if new:
            values, sizes = self.replay([w.encode() for w in new])
            place.update(zip(new, range(len(place), len(place) + len(new))))
            self.values, self.sizes = np.concatenate((self.values, values)), np.concatenate((self.sizes, sizes))
        at = np.fromiter(map(place.__getitem__, flat), np.int64, len(flat))
        starts = np.cumsum(self.sizes) - self.sizes
        sizes = self.sizes[at]
        ends = np.cumsum(sizes)
        ids = self.values[np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts[at] - (ends - sizes), sizes)]
        upto = np.concatenate(([0], ends))
        last = np.cumsum(counts)
        return ids, upto[last] - upto[last - counts]


def blocks(texts: Iterable[str | None], most: int = BLOCK_CHARS) -> Iterator[list[str | None]]:
    """The texts in lists of about ``most`` characters."""
    held: list[str | None] = []
    size = 0
    for t in texts:
        held.append(t)
        size += len(t or "") + 1
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


def _job(make: Callable, of_ids: Callable[[np.ndarray, np.ndarray], pa.Array], names: list[str]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(MergeReplay(*make()))
        for batch in batches:
            at = 0
            for texts in blocks(map(pa.StringScalar.as_py, batch.column(1)) if batch.num_rows else ()):
                ids, sizes = lexicon.encode(texts)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), of_ids(ids, sizes)], names=names)
                at += len(texts)

    return run


def _ready(df: DataFrame, id_col: str, text_col: str, file: str | None):
    shared = df.sparkSession.sparkContext.broadcast(read_merges(file or tokenizer_file()))  # of fixed size: the vocabulary's merges
    return spread(df.select(df[id_col], df[text_col].cast("string")), id_col), lambda: shared.value


def encode_corpus(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", file: str | None = None) -> DataFrame:
    """``id_col`` and ``ids`` (array<int>), a row for each row of ``df``, without special tokens.

    Null and empty texts give an empty list; a special token's string in a text is ordinary text. Null or repeated ids
    keep their rows. Other columns are left out, whatever their names. An empty table gives an empty result.
    """
    src, make = _ready(df, id_col, text_col, file)

    def lists(ids: np.ndarray, sizes: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)), pa.array(ids))

    kind = src.schema[0].dataType.simpleString()
    return src.mapInArrow(_job(make, lists, [id_col, "ids"]), f"`{id_col}` {kind}, ids array<int>")


def token_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", file: str | None = None) -> DataFrame:
    """``id_col`` and ``n_tokens`` (int): the sizes of what :func:`encode_corpus` gives, without moving the ids."""
    src, make = _ready(df, id_col, text_col, file)
    kind = src.schema[0].dataType.simpleString()
    return src.mapInArrow(_job(make, lambda _, sizes: pa.array(sizes.astype(np.int32)), [id_col, "n_tokens"]), f"`{id_col}` {kind}, n_tokens int")
