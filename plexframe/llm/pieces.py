"""SentencePiece encoding and decoding with a streaming Viterbi search.

The vocabulary is a BPE model, so a path through the lattice of pieces is admissible only if every two
neighbouring pieces are what BPE makes of their joint text; then exactly one admissible path reaches each
position and the search needs no scores. The live positions are those within the longest piece of the end; as many
positions on, at the latest, the search follows their back pointers and commits the ids before the boundary where
all of them meet, if they do. In front of a space after another sign they always meet, since no piece reaches across
it; so the ids between two such places are remembered within a task. The ids equal the library's.

Where spaces stand side by side, several pieces have one score and the pair test cannot tell which of two paths BPE
takes; there BPE is run as defined, over the spaces and the word behind them.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, spare, without

SPACE = "▁"
#: Bytes of segments that a task remembers in each of two generations.
MEMO_BYTES = 36 << 20
#: Bytes of pairs of pieces that a worker remembers: what they are does not depend on the texts.
PAIR_BYTES = 32 << 20
#: Characters of a segment that is remembered at most.
SHORT = 64


class PieceModel:
    def __init__(self, path: str):
        import ahocorasick
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        self.text = [p.piece for p in proto.pieces]
        self.dummy_prefix = proto.normalizer_spec.add_dummy_prefix
        normal = {p.piece: (i, p.score) for i, p in enumerate(proto.pieces) if p.type == 1}
        self.rank = normal
        self.byte = {int(p.piece[3:5], 16): i for i, p in enumerate(proto.pieces) if p.type == 6}
        self.value = {i: b for b, i in self.byte.items()}
        self.known = {p for p in normal if len(p) == 1}
        if any(SPACE in p.lstrip(SPACE) for p in normal):
            raise ValueError("a piece reaches across a word boundary")
        self.longest = max(map(len, normal))
        self.valid: dict[int, bool] = {}
        self.memo: dict[str, tuple[int, ...]] = {}  # by segment
        self.word: dict[str, tuple[int, ...]] = {}  # the same for words after one space, without it
        self.past: dict[str, tuple[int, ...]] = {}  # by segment, from before the last time that these were full
        self.held = 0  # bytes of memo and word
        # ASCII bytes stand for themselves; other bytes are joined by the slow path of decode
        self.plain = [chr(self.value[i]) if self.value.get(i, 128) < 128 else None if i in self.value else p for i, p in enumerate(self.text)]
        self.automaton = ahocorasick.Automaton()
        for p, (i, _) in normal.items():
            if len(p) == 1 or self.bpe(p) == [i]:  # others no BPE result holds
                self.automaton.add_word(p, (i, len(p)))
        self.automaton.make_automaton()

    def bpe(self, run: str) -> list[int]:
        """BPE by definition over known characters: always merge the best pair, leftmost first."""
        parts: list[str | None] = list(run)
        left, right = list(range(-1, len(run) - 1)), list(range(1, len(run) + 1))
        heap: list[tuple[float, int, str, str]] = []

        def offer(i: int, j: int) -> None:
            if i >= 0 and j < len(parts) and (found := self.rank.get(parts[i] + parts[j])):
                heapq.heappush(heap, (-found[1], i, parts[i], parts[j]))

        for i in range(len(run) - 1):
            offer(i, i + 1)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = right[i]
            if parts[i] != a or j >= len(parts) or parts[j] != b:
                continue
            parts[i], parts[j] = a + b, None
            right[i] = right[j]
            if right[i] < len(parts):
                left[right[i]] = i
            offer(left[i], i)
            offer(i, right[i])
        return [self.rank[p][0] for p in parts if p is not None]

    def meets(self, a: int, b: int) -> bool:
        """Whether BPE keeps pieces a and b apart and whole when they stand side by side."""
        key = a << 20 | b
        if (known := self.valid.get(key)) is None:
            if 100 * len(self.valid) > PAIR_BYTES:
                self.valid.clear()
            known = self.valid[key] = self.bpe(self.text[a] + self.text[b]) == [a, b]
        return known

    def short(self, run: str) -> list[int]:
        """The same search over a run that ends before anything would be committed."""
        meets, valid, n = self.meets, self.valid, 1
        last, sizes = [-1], [0]
        for end, (piece, length) in self.automaton.iter(run):
            if end + 1 < n:
                continue
            before = last[n - length]
            if before < 0 or (meets(before, piece) if (known := valid.get(before << 20 | piece)) is None else known):
                last.append(piece)
                sizes.append(length)
                n += 1
        ids, to = [], n - 1
        while to > 0:
            ids.append(last[to])
            to -= sizes[to]
        ids.reverse()
        return ids

    def viterbi(self, run: str) -> Iterator[int]:
        """The ids of a run of known characters, committed as the search goes."""
        meets = self.meets
        base, last = 0, [(-1, 0)]  # last[i - base]: the piece that ends at i, and its length
        look = 2 * self.longest
        for end, (piece, length) in self.automaton.iter(run):
            at = end + 1 - base
            if at < len(last):
                continue  # the one admissible piece of this position is known
            before = last[at - length][0]
            if before < 0 or meets(before, piece):
                last.append((piece, length))
                if at >= look:
                    live = set(range(len(last) - self.longest, len(last)))
                    while len(live) > 1:  # follow the paths back to where all meet
                        far = max(live)
                        live.remove(far)
                        live.add(far - last[far][1])
                    meet = live.pop()
                    if meet > 0:
                        yield from self._path(last, meet)
                        last, base = last[meet:], base + meet
                    look = len(last) - 1 + self.longest
        yield from self._path(last, len(last) - 1)

    @staticmethod
    def _path(last: list[tuple[int, int]], to: int) -> list[int]:
        ids = []
        while to > 0:
            piece, length = last[to]
            ids.append(piece)
            to -= length
        return ids[::-1]

    def segment(self, s: str) -> tuple[int, ...]:
        """The ids of a stretch that no piece leaves: unknown characters become bytes and part the runs."""
        if len(s) <= SHORT and self.known.issuperset(s) and SPACE * 2 not in s:
            return tuple(self.short(s))
        ids: list[int] = []
        run: list[str] = []

        def close() -> None:
            if run:
                joined = "".join(run)
                # equal scores among runs of spaces: there the pair test does not decide, so BPE is run as defined
                ids.extend(self.bpe(joined) if SPACE * 2 in joined else self.viterbi(joined))
                run.clear()

        for c in s:
            if c in self.known:
                run.append(c)
            else:
                close()
                ids.extend(map(self.byte.__getitem__, c.encode("utf-8", "surrogatepass")))
        close()
        return tuple(ids)

    def _keep(self, memo: dict, key: str, s: str) -> tuple[int, ...]:
        found = self.past.get(s) or self.segment(s)
        if len(s) <= SHORT:
            cost = 220 + 2 * len(s) + 8 * len(found)  # two objects and a dictionary's entry; the ids are shared
            if self.held + cost > MEMO_BYTES:
                self.past = {**self.memo, **{SPACE + w: ids for w, ids in self.word.items()}}
                self.memo.clear()
                self.word.clear()
                self.held = 0
            memo[key] = found
            self.held += cost
        return found

    def forget(self) -> None:
        self.memo.clear()
        self.word.clear()
        self.past = {}
        self.held = 0

    def encode(self, text: str) -> list[int]:
        """The ids of a text. Cut before every space that follows another sign: all paths meet there."""
        if not text:
            return []
        out: list[int] = []
        bare, word, keep = self.memo.get, self.word.get, self._keep  # both dictionaries stay the same objects
        lines = text.split("\n") if "\n" not in self.known else [text]
        newline = self.segment("\n") if len(lines) > 1 else ()
        for n, line in enumerate(lines):
            if n:
                out += newline
            words = line.replace(SPACE, " ").split(" ")
            if not (self.dummy_prefix and n == 0):
                w = words.pop(0)
                if w:
                    out += bare(w) or keep(self.memo, w, w)
            spaces = ""
            for w in words:
                if w and not spaces:
                    out += word(w) or keep(self.word, w, SPACE + w)
                elif w:
                    out += bare(spaces + SPACE + w) or keep(self.memo, spaces + SPACE + w, spaces + SPACE + w)
                    spaces = ""
                else:
                    spaces += SPACE
            if spaces:
                out += self.segment(spaces)
        return out

    def decode(self, ids) -> str:
        """The text of ids: bytes are joined as UTF-8, the space put before the text goes."""
        parts: list[str] = []
        raw = bytearray()
        text, value = self.text, self.value
        try:
            out = "".join(map(self.plain.__getitem__, ids)).replace(SPACE, " ")
            return out[1:] if self.dummy_prefix and out[:1] == " " else out
        except TypeError:
            pass
        for i in ids:
            if (b := value.get(i)) is not None:
                raw.append(b)
                continue
            if raw:
                parts.append(raw.decode("utf-8", "replace"))
                raw.clear()
            parts.append(text[i])
        if raw:
            parts.append(raw.decode("utf-8", "replace"))
        out = "".join(parts).replace(SPACE, " ")
        return out[1:] if self.dummy_prefix and out[:1] == " " else out


@lru_cache(maxsize=2)
def model(path: str | None = None) -> PieceModel:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    return PieceModel(path)


def _encoder(path: str | None, check: bool, column: str):
    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        m = model(path)
        try:
            for whole in batches:
                for start in range(0, whole.num_rows, 256):  # ids of few texts at a time
                    batch = whole.slice(start, 256)
                    parts, same = [], []
                    for text in batch.column(column).to_pylist():
                        ids = None if text is None else m.encode(text)
                        parts.append(np.array(ids or [], np.int32))
                        if check:
                            same.append(None if text is None else m.decode(ids) == text.replace(SPACE, " "))
                    lengths = np.array([len(p) for p in parts], np.int64)
                    offsets = np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)
                    lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int32)))
                    out = batch.drop_columns([column]).append_column("ids", lists).append_column("n_ids", pa.array(lengths))
                    yield out.append_column("round_trip", pa.array(same, pa.bool_())) if check else out
        finally:
            m.forget()  # the worker lives on

    return run


def encode(docs: DataFrame, text: str = "text", path: str | None = None, check: bool = False) -> DataFrame:
    """docs less the text, with ids array<int>, n_ids long and, if asked for, round_trip boolean.

    path: a sentencepiece model file; by default the public piece_bpe_32k.model. A null or empty text has no
    ids; round_trip is null for a null text. No begin or end ids are added; strings like <s> are plain text. A
    text that holds U+2581 decodes with a space there, and round_trip allows for that. Columns of docs with the
    names produced are replaced. An empty table gives an empty result.
    """
    made = ["ids", "n_ids", "round_trip"]
    rest, own = without(docs, text, *made).columns, spare(docs, "__text")
    slim = docs.select(*[F.col(f"`{c}`") for c in rest], F.col(f"`{text}`").cast("string").alias(own))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema.fields if f.name != own]
    return map_arrow(slim, _encoder(path, check, own), ", ".join([*fields, "ids array<int>", "n_ids long", *["round_trip boolean"] * check]))


def _decoder(path: str | None, column: str):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        m = model(path)
        for batch in batches:
            texts = [None if i is None else m.decode(i) for i in batch.column(column).to_pylist()]
            yield batch.drop_columns([column]).append_column("text", pa.array(texts, pa.string()))

    return run


def decode(encoded: DataFrame, ids: str = "ids", path: str | None = None) -> DataFrame:
    """encoded less ids, with the text they stand for; null ids give a null text."""
    rest, own = without(encoded, ids, "text").columns, spare(encoded, "__ids")
    slim = encoded.select(*[F.col(f"`{c}`") for c in rest], F.col(f"`{ids}`").alias(own))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema.fields if f.name != own]
    return map_arrow(slim, _decoder(path, own), ", ".join([*fields, "text string"]))
