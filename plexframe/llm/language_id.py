"""Language identification with hyperdimensional profiles.

Every letter has a random +-1 vector, fixed by a seed and its code point. A trigram is the product of its
letters' vectors, each rotated by its place (binding and permutation); a text is the sum of its trigrams'
vectors (bundling), and so is a language's prototype over its training texts. A text gets the language whose
prototype is nearest by cosine.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, spare, without

DIMS = 512
SEED = 61
#: Code points of a text that are turned into trigrams at once.
WINDOW = 1 << 17
UNKNOWN = "und"


@lru_cache(maxsize=1)
def _letters():
    """By code point: 1 if it is a letter."""
    import numpy as np

    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


@lru_cache(maxsize=65_536)
def _letter(code: int, dims: int, seed: int):
    import numpy as np

    return (np.random.Generator(np.random.PCG64([seed, code])).integers(0, 2, dims, dtype=np.int8) * 2 - 1).astype(np.int8)


def trigrams(*texts: str) -> Iterator[tuple]:
    """(codes, counts) of the trigrams of each text's letters, lower case, any run of other signs as one space."""
    import numpy as np

    # a text's own ends count as spaces; a zero stands between texts, and no trigram reaches across it
    joined = "\0".join([f" {t.lower()} ".replace("\0", " ") for t in texts])
    every = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    every = np.where(_letters()[every] | (every == 0), every, np.uint32(32))
    every = every[np.concatenate(([True], (every[1:] != 32) | (every[:-1] != 32)))]
    for i in range(0, len(every) - 2, WINDOW):
        points = every[i : i + WINDOW + 2].astype(np.int64)  # two of overlap
        a, b, c = points[:-2], points[1:-1], points[2:]
        yield np.unique((a << 42 | b << 21 | c)[(a != 0) & (b != 0) & (c != 0)], return_counts=True)


def vectors(codes, dims: int, seed: int):
    """A row for each trigram code."""
    import numpy as np

    parts = [codes >> 42, codes >> 21 & 0x1FFFFF, codes & 0x1FFFFF]
    known, at = np.unique(np.concatenate(parts), return_inverse=True)
    table = np.stack([_letter(int(c), dims, seed) for c in known])
    a, b, c = at.reshape(3, -1)
    return (np.roll(table, 2, axis=1)[a] * np.roll(table, 1, axis=1)[b] * table[c]).astype(np.float32)


def _learner(dims: int, seed: int):
    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        sums: dict[str, np.ndarray] = {}

        def bundle(lang: str, texts: list[str]) -> None:
            parts = list(trigrams(*texts))
            if not sum(len(p[0]) for p in parts):
                return
            codes, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            counts = np.bincount(at, np.concatenate([p[1] for p in parts]))
            total = sums.setdefault(lang, np.zeros(dims))
            for i in range(0, len(codes), 4096):
                total += counts[i : i + 4096] @ vectors(codes[i : i + 4096], dims, seed)

        held: dict[str, tuple[list[str], list[int]]] = {}
        for batch in batches:
            for text, lang in zip(batch.column("t"), batch.column("lang").to_pylist(), strict=True):
                texts, chars = held.setdefault(lang, ([], [0]))
                texts.append(text.as_py())
                chars[0] += len(texts[-1])
                if chars[0] > 1 << 20:
                    bundle(lang, held.pop(lang)[0])
        for lang, (texts, _) in held.items():
            bundle(lang, texts)
        for lang, total in sums.items():
            yield pa.RecordBatch.from_pydict({"lang": [lang] * dims, "dim": np.arange(dims, dtype=np.int32), "v": total})

    return run


def learn(train: DataFrame, text: str = "text", lang: str = "lang", dims: int = DIMS, seed: int = SEED, most: int = 10_000) -> dict[str, list[float]]:
    """Prototypes by language, bundled over all rows of train that have both text and lang.

    Tasks send one vector a language; the driver gets languages x dims numbers, whatever the number of rows. More than
    `most` languages are refused: then lang is no column of languages.
    """
    rows = train.select(F.col(f"`{text}`").cast("string").alias("t"), F.col(f"`{lang}`").cast("string").alias("lang")).dropna()
    sums = map_arrow(rows, _learner(dims, seed), "lang string, dim int, v double").groupBy("lang", "dim").agg(F.sum("v").alias("v"))
    out: dict[str, list[float]] = {}
    found = sums.limit((most + 1) * dims).collect()
    if len(found) > most * dims:
        raise ValueError(f"more than {most} values of {lang}")
    for r in found:
        out.setdefault(r["lang"], [0.0] * dims)[r["dim"]] = r["v"]
    return out


def _predictor(names: list[str], prototypes: list[list[float]], dims: int, seed: int, column: str):
    def predict(texts: list[str | None]) -> tuple[list[str], list[float]]:
        import numpy as np

        unit = np.array(prototypes, np.float32).reshape(-1, dims)
        norms = np.linalg.norm(unit, axis=1, keepdims=True)
        unit = unit / np.where(norms > 0, norms, 1)
        parts = [[p for p in trigrams(t) if len(p[0])] if t else [] for t in texts]
        every = [p[0] for own in parts for p in own]
        out: tuple[list[str], list[float]] = ([UNKNOWN] * len(texts), [0.0] * len(texts))
        if not every or not names:
            return out
        codes = np.unique(np.concatenate(every))
        table = vectors(codes, dims, seed)
        for i, own in enumerate(parts):
            if not own:
                continue
            doc = sum(c.astype(np.float32) @ table[np.searchsorted(codes, k)] for k, c in own)
            cosines = unit @ doc / max(float(np.linalg.norm(doc)), 1e-9)
            best = int(np.argmax(cosines))  # ties: the first name
            out[0][i], out[1][i] = names[best], float(min(1.0, max(0.0, cosines[best])))
        return out

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            texts = batch.column(column)
            langs, scores, i = [], [], 0
            while i < len(texts):
                chunk, chars = [], 0  # by size, so that a batch of long texts stays small
                while i < len(texts) and chars < 1 << 19 and len(chunk) < 256:
                    chunk.append(texts[i].as_py())
                    chars += len(chunk[-1] or "")
                    i += 1
                got = predict(chunk)
                langs += got[0]
                scores += got[1]
            rest = batch.drop_columns([column])
            yield rest.append_column("lang_pred", pa.array(langs, pa.string())).append_column("score", pa.array(scores, pa.float64()))

    return run


def has_letters(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def identify(docs: DataFrame, model: dict[str, list[float]], text: str = "text", dims: int = DIMS, seed: int = SEED, keep_text: bool = False) -> DataFrame:
    """docs with lang_pred and score (cosine, cut to 0..1), less the text unless it is asked for.

    A null text, a text without letters, and any text where nothing was learned, is `und` with score 0. Columns
    of docs with the names produced are replaced; nothing but the text is read. An empty table stays empty.
    """
    docs = without(docs, "lang_pred", "score")
    own = spare(docs, "__text")
    rest = docs if keep_text else without(docs, text)
    slim = docs.select(*[F.col(f"`{c}`") for c in rest.columns], F.col(f"`{text}`").cast("string").alias(own))
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema.fields if f.name != own], "lang_pred string", "score double"])
    names = sorted(model)
    return map_arrow(slim, _predictor(names, [model[n] for n in names], dims, seed, own), schema)


def held_out(key: str = "doc_id") -> Column:
    """The fold: crc32 of the key as text, mod 4, is 2. A null key is not held out."""
    return F.coalesce(F.pmod(F.crc32(F.col(f"`{key}`").cast("string")), F.lit(4)) == 2, F.lit(False))
