"""Benchmark decontamination by template canonicalisation.

Words become template tokens: numbers, names and units turn into typed placeholders, other words into their
lower-case core; a run of names is one placeholder, and so is a number with its unit. Windows of tokens that
stand in both a document and a benchmark item are the seeds. Around them the item is laid over the document at all
shifts of a band that is as wide as the item is long, so words may be added, dropped or changed in between. Over
the band every value that a placeholder stands for in the item has to map to one value in the document (and for
names back again); tokens that disagree with the mapping do not count. So a question with other numbers or names
is still caught. The same is done with the plain lower-case words, so that a copy is caught whatever its case and
however many of its words are placeholders.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, drop_keys, map_arrow

#: Tokens in a window. Shorter items are one window of their own length, down to LEAST tokens.
WINDOW = 8
LEAST = 4
#: Benchmark windows looked for in one pass over the documents; more are taken in blocks.
BLOCK = 2_000_000
#: The share of an item's windows that a document has to hold.
COVERAGE = 0.5
#: An edit moves what follows it by a few words; so far beside a seed's shift shorter stretches are looked for.
SLACK = 3

# Unit words that follow a number.
UNITS = frozenset(
    "mm cm m km in inch inches ft foot feet yd yard yards mile miles mg g gram grams kg kilogram kilograms lb lbs pound pounds oz ounce ounces "
    "ml l litre litres liter liters gallon gallons second seconds sec minute minutes min hour hours day days week weeks month months year years "
    "dollar dollars cent cents euro euros percent degree degrees kmh mph".split()
)
# Words that are no name although a capital begins them at the start of a sentence.
COMMON = frozenset(
    "a about after all also although altogether among an and another any anyone are as assume at because before besides both but by calculate can "
    "choose compare compute consider consequently could decide define derive describe determine did do does draw during each either estimate "
    "evaluate even every everyone evidently explain express few finally find first five for four from furthermore give given had half has have "
    "he hence her here hers him his how however i if imagine in initially instead is it its later least let list many meanwhile more most much "
    "my name neither next no nobody none nor not note now of on once one only or other our out over per perhaps please prove ten than that the "
    "their them then there therefore these they this those though three through thus to today together tomorrow two under until up use usually "
    "using we were what when where whereas whether which while who whole whom whose why with within without would write yesterday yet you "
    "your six seven eight nine she so some someone soon still such suppose solve show simplify since was be been being "
    "aber als am an auch auf aus bei bis da das dass dem den der des die dies diese dieser dieses doch du ein eine einem einen einer er es für hat "
    "ich ihr im in ist ja jede jeder man mit nach nicht noch nun nur oder ob sein seine sich sie sind so um und uns unter vom von vor wann war "
    "warum was wenn wer werden wie wieviel wir wird wo zu zum zur "
    "à au aux avec ce ces cette combien comme comment dans de des donc du elle elles en est et il ils je la le les leur lui mais nous on où ou "
    "par pas pour pourquoi quand que quel quelle qui sa sans se ses si son sont sur tu un une vous "
    "como con cómo cuando cuál cuándo cuánto cuántos de del desde dónde el ella ellos en entre era es esa ese esta este está hay la las lo los "
    "más muy ni no o para pero por porque qué quién se ser si sin sobre son su sus también tan tiene todo todos un una unas unos y ya yo".split()
)
NUMBER = re.compile(r"[$€£]?[+-]?\d[\d,]*(?:\.\d+)?%?")
GLUED = re.compile(r"([$€£]?[+-]?\d[\d,]*(?:\.\d+)?)([a-z]+)")
EDGE = "\"'`.,;:!?()[]{}<>*_|«»“”‘’…-–—"
CLOSING = "\"')]”’»"
#: Words whose reading a task remembers.
MEMO = 150_000
LITERAL, NUM, NAME, MEASURE, SKIP = range(5)
#: Kinds of sequences: template tokens, and plain lower-case words.
TEMPLATE, WORDS = range(2)


def _reading(word: str) -> tuple[int, str, bool, bool]:
    """kind, core, whether a capital begins it, whether a sentence ends after it."""
    if word.isalpha():
        return LITERAL, word.lower(), word[0].isupper(), False
    core = word.strip(EDGE)
    if core.isalpha():
        return LITERAL, core.lower(), core[0].isupper(), word[-1] in ".!?:" or (word[-1] in CLOSING and word.rstrip(CLOSING)[-1:] in (".", "!", "?"))
    ends = word[-1:] in ".!?:" or word.rstrip(CLOSING)[-1:] in (".", "!", "?")
    if not core:
        return SKIP, "", False, ends
    low = core.lower()
    if NUMBER.fullmatch(core):
        return NUM, low, False, ends
    if (m := GLUED.fullmatch(low)) and m[2] in UNITS:
        return NUM, low, False, ends
    return LITERAL, low, core[0].isupper(), ends


def _digest(label: str) -> int:
    return xxhash.xxh3_64_intdigest(label) - (1 << 63)


class Canon:
    """Turns texts into template tokens, remembering words."""

    def __init__(self):
        self.clear()

    def clear(self):
        self.at: dict[str, int] = {}
        self.rows: list[tuple] = []  # not yet in arrays
        self.arrays: list = []

    def _add(self, word: str) -> int:
        kind, core, capital, ends = _reading(word)
        number, unit = core, ""
        if kind == NUM and (m := GLUED.fullmatch(core)):
            number, unit = m.groups()
        closed = ends or kind == SKIP or not word[-1].isalnum()
        name = kind == LITERAL and capital
        self.rows.append((kind, _digest(core), _digest(number), _digest(unit) if unit else 0, name, name and core not in COMMON, ends, core in UNITS, closed))
        i = self.at[word] = len(self.at)
        return i

    def tokens(self, text: str):
        """The indices of a text's words."""
        import numpy as np

        words = text.replace("\n", " . ").split()  # a line ends a sentence
        at, add = self.at, self._add
        return np.fromiter((at[w] if w in at else add(w) for w in words), np.int64, len(words))

    def table(self):
        """kind, hashes of core, number and unit, name in or at the start of a sentence, ends, unit, closed of every word so far, as arrays."""
        import numpy as np

        if self.rows:
            types = (np.int8, np.int64, np.int64, np.int64, bool, bool, bool, bool, bool)
            new = [np.array(x, t) for x, t in zip(zip(*self.rows, strict=True), types, strict=True)]
            self.arrays = [np.concatenate(x) for x in zip(self.arrays, new, strict=True)] if self.arrays else new
            self.rows = []
        return self.arrays


def _sequences(texts: list[str], canon: Canon) -> list[tuple]:
    """The tokens of all texts end to end, for each kind of sequence: text, value, plain, and the slots a and b.

    a is what a name or number stands for, b the unit; 0 is none.
    """
    import numpy as np

    ids = [canon.tokens(t) for t in texts]
    x = np.concatenate([np.zeros(0, np.int64), *ids])
    if not len(x):
        return []
    doc = np.repeat(np.arange(len(ids)), [len(i) for i in ids])
    kind, core, number, glued, inner, outer, ends, unit, closed = canon.table()
    first = np.concatenate(([True], doc[1:] != doc[:-1]))
    begin, fresh = first.copy(), first.copy()
    begin[1:] |= ends[x[:-1]]
    fresh[1:] |= closed[x[:-1]]
    name = np.where(begin, outer[x], inner[x])
    keep = kind[x] != SKIP
    x, doc, name, fresh = x[keep], doc[keep], name[keep], fresh[keep]
    if not len(x):
        return []
    k, lit, g = kind[x], core[x], glued[x]
    same = np.concatenate(([False], doc[1:] == doc[:-1]))
    joins = name & same & ~fresh
    joins[1:] &= name[:-1]
    measure = unit[x] & same
    measure[1:] &= (k[:-1] == NUM) & (g[:-1] == 0)
    lead = ~(joins | measure)
    at = np.flatnonzero(lead)
    place = np.arange(len(x)) - at[np.cumsum(lead) - 1]
    a = np.add.reduceat(np.where(name, lit * (2 * place + 1), np.where(k == NUM, number[x], 0)), at)
    b = np.add.reduceat(np.where(measure, lit, np.where(k == NUM, g, 0)), at)
    v, k = lit[at], k[at]
    plain = (k == LITERAL) & ~name[at]
    v[name[at]] = _digest(f"\x00{NAME}")
    v[k == NUM] = _digest(f"\x00{NUM}")
    v[(k == NUM) & (b != 0)] = _digest(f"\x00{MEASURE}")
    none = np.zeros(len(x), np.int64)
    return [(doc[at], v, plain, a, b), (doc, lit, np.ones(len(x), bool), none, none)]  # TEMPLATE, WORDS


def _rolled(doc, v, plain, w: int, kind: int):
    """Hashes of the windows of w tokens, and which of them lie in one text and have enough plain words."""
    import numpy as np

    n = len(v) - w + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, bool)

    def mix(x, y):
        z = (x * np.uint64(0x9E3779B97F4A7C15)) ^ y
        z ^= z >> np.uint64(29)
        z *= np.uint64(0xBF58476D1CE4E5B9)
        return z ^ (z >> np.uint64(32))

    part, out, place, size = v.view(np.uint64), np.full(n, 16 * w + kind, np.uint64), 0, 1
    while size <= w:  # windows of 1, 2, 4, ... tokens; w is a sum of such sizes
        if w & size:
            out = mix(out, part[place : place + n])
            place += size
        part = mix(part[:-size], part[size:])
        size *= 2
    many = np.concatenate(([0], np.cumsum(plain)))
    return out.view(np.int64), (doc[:n] == doc[w - 1 :]) & (2 * (many[w:] - many[:-w]) >= w)


def _item_tokens(batches: Iterator) -> Iterator:
    """The sequences of the items: item, kind (of sequence), v, plain, a, b."""
    import numpy as np
    import pyarrow as pa

    canon = Canon()
    for batch in batches:
        keys = batch.column(0).to_pylist()
        out: dict[str, list] = {c: [] for c in ("item", "kind", "v", "plain", "a", "b")}
        for kind, (doc, *parts) in enumerate(_sequences([t or "" for t in batch.column(1).to_pylist()], canon)):
            cuts = np.searchsorted(doc, np.arange(len(keys) + 1))
            for key, lo, hi in zip(keys, cuts[:-1], cuts[1:], strict=True):
                if key is not None and hi - lo >= LEAST:
                    for c, x in zip(out, (key, kind, *[p[lo:hi] for p in parts]), strict=True):
                        out[c].append(x)
        types = [pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int64()), pa.list_(pa.int64())]
        yield pa.RecordBatch.from_pydict({c: pa.array(v, t) for (c, v), t in zip(out.items(), types, strict=True)})


def _index(rows: list) -> tuple:
    """The items of a block, and by hash of a window: its item's place among them and its place in the item."""
    import numpy as np

    items, shapes = [], {}
    for r in rows:
        v, plain, a, b = (np.array(r[c], t) for c, t in (("v", np.int64), ("plain", bool), ("a", np.int64), ("b", np.int64)))
        w = min(WINDOW, len(v))
        shapes.setdefault((r["kind"], w), []).append(len(items))
        items.append([r["item"], r["kind"], w, v, plain, a, b, None])
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32))]
    for (kind, w), own in shapes.items():
        lens = [len(items[i][3]) for i in own]
        doc = np.repeat(np.array(own), lens)
        h, telling = _rolled(doc, np.concatenate([items[i][3] for i in own]), np.concatenate([items[i][4] for i in own]), w, kind)
        starts = np.concatenate(([0], np.cumsum(lens)))[:-1]
        for i, s, n in zip(own, starts, lens, strict=True):
            items[i][7] = telling[s : s + n - w + 1]
        at = np.flatnonzero(telling)
        pos = at - np.repeat(starts, lens)[at]
        found.append((h[at], doc[at].astype(np.int32), pos.astype(np.int32)))
    h, row, pos = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.argsort(h, kind="stable")
    return items, sorted(shapes), h[order], row[order], pos[order]


def _stretches(eq, w: int):
    """The true cells of eq that lie in w or more of them side by side, and where w of them begin."""
    import numpy as np

    c = np.cumsum(np.pad(eq, ((0, 0), (1, 0))), axis=1, dtype=np.int32)
    full = c[:, w:] - c[:, :-w] == w
    out = np.zeros_like(eq)
    for j in range(w):
        out[:, j : j + full.shape[1]] |= full
    return out, full


def _agreed(eq, strong, item, mine, theirs, names: bool):
    """eq less the cells whose slot disagrees with the mapping that most cells support."""
    import numpy as np

    at = np.nonzero(eq & (mine != 0))
    pairs = list(zip(mine[at[1]].tolist(), theirs[at].tolist(), strict=True))
    if all(x == y for x, y in pairs):
        return eq
    votes: dict[tuple, int] = {}
    for pair, s in zip(pairs, strong[at].tolist(), strict=True):
        votes[pair] = votes.get(pair, 0) + (eq.shape[1] if s else 1)
    called = set(mine[item == _digest(f"\x00{NAME}")].tolist()) if names else set()
    to: dict[int, int] = {}
    taken: dict[int, int] = {}
    for x, y in sorted(votes, key=lambda p: -votes[p]):  # ties: the first in the item
        if x not in to and not (x in called and y in taken):
            to[x] = y
            if x in called:
                taken[y] = x
    eq = eq.copy()
    wrong = np.array([to.get(x) != y for x, y in pairs], bool)
    eq[at[0][wrong], at[1][wrong]] = False
    return eq


def _held(v, a, b, item: list, shifts) -> tuple[int, bool]:
    """How many telling windows of the item the text holds within the best band of shifts; whether slots differ.

    A window is held if all its tokens but one stand in agreeing stretches of LEAST tokens or more, of which one
    is a whole telling window.
    """
    import numpy as np

    _, _, w, iv, _, ia, ib, telling = item
    size, best = len(iv), (0, False)
    shifts = np.unique(shifts)
    until = np.searchsorted(shifts, shifts + size, "right")
    for i in np.flatnonzero(np.concatenate(([True], until[1:] > until[:-1]))).tolist():
        near = np.unique((shifts[i : until[i], None] + np.arange(-SLACK, SLACK + 1)).ravel())
        cells = near[:, None] + np.arange(size)
        inside = (cells >= 0) & (cells < len(v))
        cells = np.where(inside, cells, 0)
        eq, _ = _stretches(inside & (v[cells] == iv), LEAST)
        strong, _ = _stretches(eq, w)
        eq = _agreed(_agreed(eq, strong, iv, ia, a[cells], True), strong, iv, ib, b[cells], False)
        eq, _ = _stretches(eq, LEAST)
        if not (_stretches(eq, w)[1] & telling).any():
            continue
        gaps = np.concatenate(([0], np.cumsum(~eq.any(axis=0))))
        n = int((telling & (gaps[w:] - gaps[:-w] <= 1)).sum())
        changed = bool((eq & ((a[cells] != ia) | (b[cells] != ib))).any())
        best = max(best, (n, changed), key=lambda x: (x[0], not x[1]))
        if best == (int(telling.sum()), False):
            break
    return best


def _finder(wanted, coverage: float):
    """The items that documents hold: key, item, kind, n, n_matched, changed."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        items, shapes, known, row, pos = wanted.value
        sieve = np.zeros(1 << 22, bool)
        sieve[known & (len(sieve) - 1)] = True
        names = ("key", "item", "kind", "n", "n_matched", "changed")
        types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.bool_()]
        canon = Canon()

        def look(keys: list, texts: list[str]) -> list[tuple]:
            out, sequences = [], _sequences(texts, canon)
            for kind, w in shapes:
                if kind >= len(sequences):
                    continue
                doc, v, plain, a, b = sequences[kind]
                h, telling = _rolled(doc, v, plain, w, kind)
                maybe = np.flatnonzero(sieve[h & (len(sieve) - 1)] & telling)
                lo = np.searchsorted(known, h[maybe])
                many = np.searchsorted(known, h[maybe], "right") - lo
                at = np.repeat(maybe, many)
                if not len(at):
                    continue
                entry = np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(lo, many)
                d, r, shift = doc[at], row[entry], at - pos[entry]
                order = np.lexsort((r, d))
                d, r, shift = d[order], r[order], shift[order]
                cuts = np.flatnonzero(np.concatenate(([True], (d[1:] != d[:-1]) | (r[1:] != r[:-1]), [True])))
                for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                    s, e = np.searchsorted(doc, [d[i], d[i] + 1])
                    item = items[r[i]]
                    n, (m, changed) = int(item[7].sum()), _held(v[s:e], a[s:e], b[s:e], item, shift[i:j] - s)
                    if m and m >= n * coverage:
                        out.append((keys[d[i]], item[0], kind, n, m, changed))
            return out

        for batch in batches:
            keys, texts, i = batch.column(0).to_pylist(), batch.column(1), 0
            while i < len(keys):
                part, held = [], 0
                while i + len(part) < len(keys) and held < 1 << 20:
                    part.append(texts[i + len(part)].as_py() or "")
                    held += len(part[-1])
                if len(canon.at) > MEMO:
                    canon.clear()
                out = look(keys[i : i + len(part)], part)
                i += len(part)
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)], names)

    return run


def find_leaks(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", coverage: float = COVERAGE) -> DataFrame:
    """One row per (key, item) where the document holds the item: n_windows, n_matched (longs), reparameterised.

    A document holds an item if, over one band of neighbouring shifts, at least `coverage` of the item's windows
    stand in it: windows of its template with consistent slots, or windows of its plain words. The counts are those
    of the sequence of which more is held; reparameterised says that some slot's value differs. Template windows with
    fewer plain words than placeholders are no evidence; items of fewer than LEAST tokens have none. Null texts and items hold
    nothing; null keys are ignored. Rows repeated with one key and text count once. Other columns are not read. With
    an empty table on either side the result is empty.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    items = benchmark.select(F.col(f"`{item}`").cast("long").alias("k"), F.col(f"`{item_text}`").cast("string").alias("t")).dropna()
    tokens = scratch.table(map_arrow(items, _item_tokens, "item long, kind int, v array<long>, plain array<boolean>, a array<long>, b array<long>"))
    blocks = max(1, -(-(tokens.agg(F.sum(F.size("v"))).first()[0] or 0) // BLOCK))
    slim = docs.select(F.col(f"`{key}`").cast("long").alias("k"), F.col(f"`{text}`").cast("string").alias("t")).dropna()
    schema = "key long, item long, kind int, n long, n_matched long, changed boolean"
    lines = spark.createDataFrame([], schema)
    for i in range(blocks):  # the benchmark is the stated query set
        block = tokens.filter(F.pmod(F.xxhash64("item"), F.lit(blocks)) == i).collect()
        if block:
            lines = lines.union(map_arrow(slim, _finder(spark.sparkContext.broadcast(_index(block)), coverage), schema))
    best = lines.groupBy("key", "item").agg(F.max(F.struct(F.expr("n_matched / n"), (-F.col("kind")).alias("kind"), (~F.col("changed")).alias("same"), "n_matched", "n")).alias("b"))
    return best.select(F.col("key").alias(key), F.col("item").alias(item), F.col("b.n").alias("n_windows"), F.col("b.n_matched").alias("n_matched"), (~F.col("b.same")).alias("reparameterised"))


def drop_leaks(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", coverage: float = COVERAGE) -> DataFrame:
    """docs less those that hold a benchmark item."""
    return drop_keys(docs, key, find_leaks(docs, benchmark, key, text, coverage=coverage).select(f"`{key}`"))
