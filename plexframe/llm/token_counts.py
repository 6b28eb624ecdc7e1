"""Token counts of whole texts, with overlap resynchronisation for huge documents.

A document longer than CHUNK_CHARS is encoded in overlapping chunks with offsets. Two neighbouring chunks are
spliced at a boundary in their overlap that both encodings share and that is proven stable: it lies before a blank
between two other signs, and the tokenizer's file shows that its normaliser and its splitter never join anything
across such a place. If the overlap has no such boundary it is widened, up to the whole rest of the text.

A shorter document is one chunk. It is cut at the same proven places, and each distinct part is encoded once a task.
A tokenizer whose file proves nothing of the kind encodes every text whole.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, spare, utf8_bytes, without

CHUNK_CHARS = 1 << 14
OVERLAP_CHARS = 1 << 9
#: Bytes of parts, and what keeps them, that a task remembers.
MEMO_BYTES = 48 << 20
BLANK = " \t\n\r"
#: A stretch of blanks and what follows up to the next one.
PART = re.compile(r"[ \t\n\r]*[^ \t\n\r]+|[ \t\n\r]+")
#: Blanks beyond those four: a text that holds one is not cut into parts.
ODD_BLANK = re.compile(r"[^\S \t\n\r]")

# Split patterns of public tokenizers no alternative of which matches a sign and then a blank.
SPLITS = frozenset([r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"])
#: Normalisers that leave both sides of a blank to themselves.
LOCAL = frozenset(["NFC", "NFD", "NFKC", "NFKD", "Lowercase"])


@lru_cache(maxsize=4)
def tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    out = Tokenizer.from_file(path)
    out.no_truncation()
    out.no_padding()
    return out


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _steps(part: dict | None, inner: str) -> list[dict]:
    if part is None:
        return []
    return [y for x in part[inner] for y in _steps(x, inner)] if part["type"] == "Sequence" else [part]


@lru_cache(maxsize=4)
def parts_at_blanks(path: str) -> bool:
    """Whether the file proves that tokens never depend on both sides of a place between a sign and a blank after it."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    for x in spec.get("added_tokens") or []:
        if x["lstrip"] or x["rstrip"] or x["single_word"] or x["normalized"] or re.search(r"\s", x["content"]):
            return False
    for x in _steps(spec.get("normalizer"), "normalizers"):
        runs = x["type"] == "Replace" and x["pattern"] == {"Regex": "\\s+"} and x["content"] == " "
        if x["type"] not in LOCAL and not runs:
            return False
    split = False
    for x in _steps(spec.get("pre_tokenizer"), "pretokenizers"):
        if x["type"] == "ByteLevel" and not x["add_prefix_space"]:
            split = split or x["use_regex"]
        elif x["type"] == "Split" and x["pattern"].get("Regex") in SPLITS:
            split = True
        else:
            return False
    return split and spec["model"]["type"] == "BPE"


def _stable(text: str, p: int) -> bool:
    return 0 < p < len(text) - 1 and text[p] in BLANK and not text[p - 1].isspace() and not text[p + 1].isspace()


def _edges(tok, text: str, start: int, end: int) -> list[tuple[int, int]]:
    return [(start + a, start + b) for a, b in tok.encode(text[start:end], add_special_tokens=False).offsets]


def _after(edges: list[tuple[int, int]], p: int) -> int | None:
    """How many tokens end at or before p, or None if a token lies across it."""
    n = 0
    for a, b in edges:
        if b <= p:
            n += 1
        elif a < p:
            return None
        else:
            break
    return n


def count_huge(tok, text: str, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> int:
    """The number of tokens of the text, holding the tokens of one chunk and its overlaps at a time."""
    total, start, size = 0, 0, len(text)
    end = min(size, chunk)
    here = _edges(tok, text, start, end)
    while end < size:
        wide = overlap
        while True:
            nxt = max(start, end - wide)
            stop = min(size, max(end + 1, nxt + chunk))
            there = _edges(tok, text, nxt, stop)
            spliced = None
            for p in range(end - 1, nxt, -1):
                if not _stable(text, p):
                    continue
                left, skip = _after(here, p), _after(there, p)
                if left is not None and skip is not None:
                    spliced = left, skip, p
                    break
            if spliced or (nxt == start and stop == size):
                break
            wide *= 2  # no common stable boundary: look further back, and further on
            if nxt == start:
                chunk *= 2
        if spliced is None:
            return total + len(there)
        left, skip, p = spliced
        total += left
        start, end, here = p, stop, there[skip:]
    return total + len(here)


def _counter(path: str | None, chunk: int, overlap: int, column: str):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        tok = tokenizer(path or vocabulary())
        proven = parts_at_blanks(path or vocabulary())
        memo: dict[str, int] = {}
        held = 0

        def lengths(texts: list[str]) -> list[int]:
            return [len(e) for e in tok.encode_batch_fast(texts, add_special_tokens=False)]

        def whole(texts: list[str]) -> list[int]:
            """Counts of texts of at most a chunk."""
            nonlocal held
            cut = [PART.findall(x) if proven and not ODD_BLANK.search(x) else [x] for x in texts]
            fresh = list({w for c in cut for w in c if w not in memo})
            size = sum(map(len, fresh)) + 120 * len(fresh)
            if held + size > MEMO_BYTES:
                memo.clear()
                held, fresh = 0, list({w for c in cut for w in c})
            held += size
            memo.update(zip(fresh, lengths(fresh), strict=True))
            return [sum(map(memo.__getitem__, c)) for c in cut]

        for batch in batches:
            texts, n_tokens, i = batch.column(column), [], 0
            while i < len(texts):
                some, at, size = [], [], 0  # by size, so that a batch of long texts stays small
                while i < len(texts) and size < 1 << 20:
                    x = texts[i].as_py() or ""
                    i += 1
                    size += len(x)
                    if len(x) > chunk:
                        n_tokens.append(count_huge(tok, x, chunk, overlap) if proven else lengths([x])[0])
                    else:
                        at.append(len(n_tokens))
                        some.append(x)
                        n_tokens.append(0)
                for j, n in zip(at, whole(some), strict=True):
                    n_tokens[j] = n
            yield batch.drop_columns([column]).append_column("n_tokens", pa.array(n_tokens, pa.int64()))

    return run


def count_tokens(docs: DataFrame, text: str = "text", path: str | None = None, limit: int = 2048, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> DataFrame:
    """docs less the text, with n_bytes, n_tokens (longs) and over_limit (n_tokens > limit).

    path: a tokenizers .json file; by default the public word_bpe_49k.json. No tokens are added; special strings
    inside a text are read as the library does by default. A null or empty text has 0 tokens. Columns of docs
    with the names produced are replaced. An empty table gives an empty result.
    """
    rest = without(docs, text, "n_bytes", "n_tokens", "over_limit").columns
    own = spare(docs, "__text")
    slim = docs.select(*[F.col(f"`{c}`") for c in rest], utf8_bytes(F.col(f"`{text}`")).alias("n_bytes"), F.col(f"`{text}`").cast("string").alias(own))
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema.fields if f.name != own], "n_tokens long"])
    return map_arrow(slim, _counter(path, chunk, overlap, own), schema).withColumn("over_limit", F.col("n_tokens") > limit)
