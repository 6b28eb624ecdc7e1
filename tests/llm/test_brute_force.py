"""The queries without SQL, and the pipeline, held against plain versions on a small folder of tables."""

import os
import random
import re
import shutil
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from plexframe.llm import decontaminate, exact_dedup, jaccard_join, language_id, license_scan, line_dedup, queries, sharding, token_counts, warc
from tests.llm.test_line_runs import brute as brute_runs

TONGUES = {
    "aa": "lorem ipsum dolor sit amet consectetur adipiscing elit sed eiusmod tempor",
    "bb": "schnell über die straße gehen wir heute abend nach hause zurück jetzt",
    "cc": "el niño come una manzana roja y la señora canta muy bien mañana",
}
ITEMS = {1: "Then a clerk counted 48 parcels for Betty before lunch and sent half as many to Betty after lunch so how many parcels in total", 2: None, 3: "short one"}


def made():
    """(doc_id, text, lang, source): three languages, copies, near copies, repeated passages, items, empty and null rows."""
    rng = random.Random(11)
    say = lambda lang, n: " ".join(f"{rng.choice(TONGUES[lang].split())}{rng.choice(['', '', 'en', 'os'])}" for _ in range(n))
    rows = []
    for i in range(90):
        lang = list(TONGUES)[i % 3]
        rows.append((i, "\n".join(say(lang, rng.randint(6, 25)) for _ in range(rng.randint(1, 5))), lang, "hot" if i % 3 else "cold"))
    passage = "\n".join(say("aa", 12) for _ in range(6))
    rows += [(100 + i, f"{say('aa', 9)}\n{passage}\n{say('aa', 8)}", "aa", "hot") for i in range(5)]
    rows += [(200 + i, rows[7][1], rows[7][2], "hot") for i in range(4)]
    long = say("bb", 120).split()
    for i in range(4):
        rows.append((300 + i, " ".join([*long[: 20 * i], f"neu{i}", *long[20 * i :]]), "bb", "hot"))
    rows += [(400, f"{say('cc', 9)} {ITEMS[1]}. {say('cc', 9)}", "cc", "x"), (401, f"{say('cc', 5)} {ITEMS[1].replace('48', '52').replace('Betty', 'Mary Ann')} {say('cc', 7)}", "cc", "x")]
    rows += [(500, None, "aa", "x"), (501, "", "aa", "x"), (502, " 12 .. 7 \n", None, "x"), (503, rows[3][1].upper(), None, "x"), (504, "x" * 30_000, None, "x")]
    return rows


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tables"))
    rows = [(i, t, lang, s, None if t is None else len(t)) for i, t, lang, s in made()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(list(ITEMS.items()), "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def test_op1(spark, folder):
    out = {r.doc_id: r for r in queries.op1_shards(spark, folder).collect()}
    texts = {i: t or "" for i, t, *_ in made()}
    assert set(out) == set(texts) and {r.law for r in out.values()} == {"key"}
    for i, t in texts.items():
        r, raw = out[i], t.encode()
        assert (r.size, r.text_crc32) == (len(raw) + 1, zlib.crc32(raw)) and r.grown_shard in (r.shard, 8) and 0 <= r.shard < 8
    assert any(r.grown_shard == 8 for r in out.values())
    slots = {s: sorted(r.slot for r in out.values() if r.shard == s) for s in range(8)}
    assert all(v == list(range(len(v))) for v in slots.values())
    # the same wherever the table lies and however it is dealt, and not the order of the ids
    other = f"{folder}-moved"
    shutil.copytree(folder, other)
    again = {r.doc_id: (r.shard, r.slot) for r in queries.op1_shards(spark, other).collect()}
    assert again == {i: (r.shard, r.slot) for i, r in out.items()}
    assert any([i for i, r in sorted(out.items(), key=lambda x: x[1].slot) if r.shard == s] != sorted(i for i, r in out.items() if r.shard == s) for s in range(8))


def test_shards_against_fisher_yates(spark):
    rows = [(i, "t" * (i % 50), "c") for i in range(400)] + [(7, "t" * 7, "c")] * 30 + [(None, None, None)] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string, size string").repartition(5)
    out = sharding.shard_shuffle(df, 3, bucket_bytes=900).collect()
    assert Counter((r.doc_id, r.text) for r in out) == Counter((i, t) for i, t, _ in rows)
    # the plain version: sort each bucket by the rows' hash, then swap from the end down
    hashes = sharding.shard_shuffle(df, 3, bucket_bytes=900).drop("size", "shard", "slot", "bucket")
    hashes = hashes.distinct().select("*", F.xxhash64(F.lit(20178), "doc_id", "text").alias("h")).collect()
    at = {(r.doc_id, r.text): r.h for r in hashes}
    for bucket in {r.bucket for r in out}:
        held = sorted((r for r in out if r.bucket == bucket), key=lambda r: r.slot)
        place = np.array(sorted(at[r.doc_id, r.text] for r in held))
        rng, index = np.random.Generator(np.random.PCG64([20177, bucket])), np.arange(len(held))
        rng.shuffle(index)
        assert [at[r.doc_id, r.text] for r in held] == place[index].tolist()


def plain_vector(text, dims=language_id.DIMS):
    """The bundle of a text's trigrams, one after another."""
    letter = {}

    def vector(c):
        if c not in letter:
            letter[c] = np.random.Generator(np.random.PCG64([language_id.SEED, ord(c)])).integers(0, 2, dims, dtype=np.int8).astype(int) * 2 - 1
        return letter[c]

    s = re.sub(" +", " ", "".join(c if c.isalpha() else " " for c in f" {(text or '').lower()} "))
    total = np.zeros(dims)
    for i in range(len(s) - 2):
        total += np.roll(vector(s[i]), 2) * np.roll(vector(s[i + 1]), 1) * vector(s[i + 2])
    return total, any(c.isalpha() for c in text or "")


def plain_languages(rows):
    sums = {}
    for i, t, lang, _ in rows:
        if t is not None and lang is not None and zlib.crc32(str(i).encode()) % 4 != 2:
            sums[lang] = sums.get(lang, 0) + plain_vector(t)[0]
    out = {}
    for i, t, *_ in rows:
        v, some = plain_vector(t)
        cos = {lang: float(v @ p / (np.linalg.norm(v) * np.linalg.norm(p))) for lang, p in sums.items()} if some else {"und": 0.0}
        best = max(sorted(cos), key=cos.get)
        out[i] = (zlib.crc32(str(i).encode()) % 4 == 2, best, max(0.0, cos[best]))
    return out


def test_op2(spark, folder):
    want = plain_languages(made())
    got = {r.doc_id: r for r in queries.op2_language_id(spark, folder).collect()}
    assert set(got) == set(want)
    for i, (held, lang, score) in want.items():
        assert (got[i].held_out, got[i].lang_pred) == (held, lang) and got[i].score == pytest.approx(score, abs=1e-5), i


def test_window_edges():
    text = "ab cd  " * 30_000
    whole = Counter()
    for codes, counts in language_id.trigrams(text):
        whole.update(dict(zip(codes.tolist(), counts.tolist(), strict=True)))
    s = re.sub(" +", " ", f" {text} ")
    assert sum(whole.values()) == len(s) - 2 and len(whole) == len({s[i : i + 3] for i in range(len(s) - 2)})


def test_op4(spark, folder):
    out = queries.op4_decontaminate(spark, folder).collect()
    assert {(r.doc_id, r.item_id, r.reparameterised) for r in out} == {(400, 1, False), (401, 1, True)}


@pytest.mark.parametrize("d", ["/root/testdata/sf0.001"])
def test_leaks_on_documents(spark, d):
    """Every document that holds an item's words one after another is found, and what is found shares most of its template."""
    words = lambda t: [w for x in (t or "").split() if (w := x.strip(decontaminate.EDGE).lower())]
    docs = {r.doc_id: words(r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    items = {r.item_id: words(r.text) for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()}
    joined = {i: f" {' '.join(w)} " for i, w in docs.items()}
    exact = {(i, k) for i, text in joined.items() for k, w in items.items() if len(w) >= 8 and f" {' '.join(w)} " in text}
    found = {(r.doc_id, r.item_id) for r in queries.op4_decontaminate(spark, d).collect()}
    assert exact <= found
    grams = lambda w: {tuple("#" if x[:1].isdigit() else x for x in w[i : i + 4]) for i in range(len(w) - 3)}
    for i, k in found:
        assert len(grams(items[k]) & grams(docs[i])) >= 0.3 * len(grams(items[k]))


@pytest.mark.parametrize("d", ["/root/testdata/sf0.001"])
def test_op6(spark, d):
    from tests.llm.test_short_notices import brute

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    found = {}
    for r in queries.op6_license_scan(spark, d).collect():
        found.setdefault(r.doc_id, set()).add((r.license_id, round(r.containment, 6)))
    assert found == {i: b for i, t in texts.items() if (b := brute(t or ""))}


def test_licenses_odd(spark):
    mit = license_scan.TEMPLATES["mit"]
    rows = [(None, mit), (1, mit), (1, mit), (2, "word " * 40_000 + mit + " word" * 40_000), (3, f"{mit} x y z a b c d e {mit}"), (4, None)]
    out = license_scan.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.license_id, r.first_word) for r in out if r.doc_id != 2) == [(0, "mit", 0), (1, "mit", 0), (3, "mit", 0)]
    assert [39_995 < r.first_word <= 40_000 for r in out if r.doc_id == 2] == [True]


def plain_groups(texts):
    sets = {}
    for d, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d for d in sets if find(d) == d}


def test_pipeline(spark, folder):
    sentencepiece = pytest.importorskip("sentencepiece")
    import public_tokenizers

    lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    lang = {i: x[1] for i, x in plain_languages(made()).items()}
    texts = {i: t for i, t, *_ in made() if lang[i] != "und"}
    texts = brute_runs(texts)
    texts = {i: texts[i] for i in plain_groups(texts)}
    assert 400 in texts and 401 in texts
    want = {i: (lang[i], lib.encode(t)) for i, t in texts.items() if i not in (400, 401)}
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, folder).collect()}
    assert set(out) == set(want) and {301, 302, 303, 500, 502}.isdisjoint(out)
    assert all((r.lang, list(r.ids)) == want[i] and r.round_trip for i, r in out.items())


def test_pipeline_odd(spark, tmp_path):
    """Stages on empty tables, null and repeated keys, null texts and further columns keep the columns of documents."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, size string, __gone int, bucket string"
    rows = [(1, "lorem ipsum dolor", "aa", "s", 17, "x", 1, "y"), (1, "lorem ipsum dolor", "aa", "s", 17, "x", 1, "y"), (None, "lorem ipsum", "aa", None, None, None, None, None), (3, None, None, None, None, None, None, None), (4, "", "aa", "s", 0, "x", 2, "z")]
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for given in (rows, []):
        docs = spark.createDataFrame(given, schema)
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, str(tmp_path))
            assert out.columns == docs.columns and out.count() <= len(given)
        assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() == len(given)


def test_repeated_keys(spark):
    passage = "\n".join(f"line {i} of a passage" for i in range(12))
    rows = [(1, passage), (2, f"{passage}\ntail"), (2, "completely\ndifferent")]
    out = line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert "completely\ndifferent" in {r.text for r in out}
    long = " ".join(f"w{i}" for i in range(40))
    rows = [(1, long), (2, "quite another text of some words here"), (2, long), (3, "quite another text of some words here"), (2, long)]
    out = jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), k=4, num=85, den=100).collect()
    by = {r.doc_id: {x.component_id for x in out if x.doc_id == r.doc_id} for r in out}
    assert by in ({1: {1}, 2: {1}, 3: {3}}, {1: {1}, 2: {2}, 3: {2}}) and sorted(r.n_shingles for r in out) == [4, 4, 37, 37, 37]
    kept = exact_dedup.drop_copies(spark.createDataFrame([(1, "a b"), (2, "ab"), (2, "other")], "doc_id long, text string")).collect()
    assert {(r.doc_id, r.text) for r in kept} == {(1, "a b"), (2, "other")}


def test_hot_lists(spark, monkeypatch):
    """Many sets around one passage, too far apart to link with the first: compared in blocks, each pair once."""
    monkeypatch.setattr(jaccard_join, "LIST_BLOCK", 7)
    rng = random.Random(3)
    common = [f"c{i}" for i in range(60)]
    texts = {i: " ".join([*common, *[f"own{i // 2}x{j}" for j in range(18)], *[f"r{rng.random()}" for _ in range(rng.choice((0, 1, 2, 30)))]]) for i in range(90)}
    from tests.llm.test_operators import brute

    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    assert {tuple(r) for r in jaccard_join.jaccard_components(df, k=2, num=4, den=5).collect()} == brute(texts, 2, 4, 5)


def pages(spark, n=60):
    rng = random.Random(2)
    return spark.createDataFrame([(i, f"http://x/{i}", "".join(rng.choice("abcdefgh <>") for _ in range(rng.randint(0, 3000)))) for i in range(n)], "page_id long, url string, html string").repartition(3)


def test_damaged_archives(spark, tmp_path):
    manifest = warc.write_warc(warc.with_revisits(pages(spark)), f"file://{tmp_path}/a")
    assert warc.read_warc(manifest, 5000).count() == 60
    assert warc.read_warc(manifest, 5000).rdd.getNumPartitions() >= sum(-(-r.size // 5000) for r in manifest.collect())
    listed = warc.list_warc(spark, f"file://{tmp_path}/a")
    assert warc.read_warc(listed, 20_000).count() == 60
    files = sorted(f for f in os.listdir(f"{tmp_path}/a") if f.endswith(".warc.gz"))
    for at in (3, 700, 5003, -30):
        d = f"{tmp_path}/b{at}"
        shutil.copytree(f"{tmp_path}/a", d)
        for f in os.listdir(d):
            if f.startswith("."):
                os.remove(f"{d}/{f}")
        raw = bytearray(open(f"{d}/{files[0]}", "rb").read())
        raw[at] ^= 0x10
        open(f"{d}/{files[0]}", "wb").write(raw)
        for split in (400, 5000, 1 << 20):
            with pytest.raises(Exception, match="DamagedArchive|no record can be read|does not match|invalid"):
                warc.read_warc(warc.list_warc(spark, f"file://{d}"), split).count()
    assert 50 <= warc.read_warc(warc.list_warc(spark, f"file://{tmp_path}/b700"), 5000, skip_damaged=True).count() < 60


def test_warc_clashing_columns(spark):
    df = pages(spark, 5).withColumns({"payload": F.lit(1), "file": F.lit("x"), "record_type": F.lit("y"), "main": F.lit(3)})
    assert warc.round_trip(df).count() == 5


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_tokenizers(spark, name):
    path = token_counts.vocabulary(name)
    assert token_counts.parts_at_blanks(path)
    tok, rng = token_counts.tokenizer(path), random.Random(4)
    texts = ["", " ", "  two  spaces ", "a  b　c \x1f!", "no" * 4000, "it's <|endoftext|> we'll  \n\n x", *["".join(rng.choice("ab'1.é \n\t<|> 日") for _ in range(rng.randint(0, 3000))) for _ in range(40)], *[" ".join("w" * rng.randint(1, 9) for _ in range(900)) for _ in range(5)]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = {i: len(tok.encode(t, add_special_tokens=False)) for i, t in enumerate(texts)}
    for chunk, overlap in ((1 << 14, 512), (200, 11)):
        got = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(df, path=path, chunk=chunk, overlap=overlap).collect()}
        assert {i: (got[i], want[i]) for i in want if got[i] != want[i]} == {}


def test_unproven_tokenizer(tmp_path):
    import json

    with open(token_counts.vocabulary("byte_bpe_50k.json"), encoding="utf-8") as f:
        spec = json.load(f)
    for change in ({"pre_tokenizer": None}, {"normalizer": {"type": "Prepend", "prepend": " "}}, {"pre_tokenizer": spec["pre_tokenizer"] | {"add_prefix_space": True}}, {"added_tokens": [spec["added_tokens"][0] | {"lstrip": True}]}):
        path = f"{tmp_path}/{len(os.listdir(tmp_path))}.json"
        with open(path, "w", encoding="utf-8") as f:
            json.dump({k: v for k, v in (spec | change).items()}, f)
        assert not token_counts.parts_at_blanks(path)
