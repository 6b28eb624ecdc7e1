import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from plexframe.llm import decontaminate, exact_dedup, jaccard_join, language_id, license_scan, line_dedup, pieces, sharding, token_counts, warc

DOCS = "doc_id long, text string, lang string, source string, size string, kept string"
ODD = [None, "", " \n\t", "a", "a b", "one two three four five", "x" * 70_000, ("long words here " * 9000).strip(), "one two three four five", None, "é ß 日本 🙂 <|endoftext|> <s>"]


def docs(spark, texts=ODD, repeat=True):
    rows = [(i, t, "en" if i % 2 else None, "s", "clash", "clash") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows + ([rows[5], (None, "no key", "en", "s", "", "")] if repeat else []), DOCS).repartition(3)


def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_shards(spark):
    out = sharding.shard_shuffle(docs(spark), 4, bucket_bytes=10_000).collect()
    assert len(out) == len(ODD) + 2
    for s in {r.shard for r in out}:
        assert sorted(r.slot for r in out if r.shard == s) == list(range(sum(r.shard == s for r in out)))
    again = sharding.shard_shuffle(docs(spark).repartition(5), 4, bucket_bytes=10_000).collect()
    assert {(r.doc_id, r.shard, r.slot) for r in out} == {(r.doc_id, r.shard, r.slot) for r in again}
    assert sharding.shard_shuffle(empty(spark)).count() == 0
    grown = spark.range(2000).select("id", sharding.rendezvous(F.col("id"), 8, 1).alias("a"), sharding.rendezvous(F.col("id"), 9, 1).alias("b")).collect()
    assert all(r.a == r.b or r.b == 8 for r in grown)


def test_exact_dedup(spark):
    out = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(docs(spark)).collect()}
    assert {(0, 2, 4, False), (1, 2, 4, False), (2, 2, 4, True), (9, 2, 4, False), (5, 5, 3, True), (8, 5, 3, False), (3, 3, 1, True), (None, None, 1, True)} <= out
    assert exact_dedup.exact_dedup(empty(spark)).count() == 0


def test_line_dedup(spark):
    passage = " ".join(f"word{i}" for i in range(60))
    block = "\n".join(f"line number {i} of a block" for i in range(12))
    texts = [f"first\n{passage}\nrest", f"other start\n{passage}", block, f"x\n{block}\ny", "Of.", "Of.", None, ""]
    out = {r.doc_id: r for r in line_dedup.line_dedup(docs(spark, texts, False)).collect()}
    assert out[0].text == texts[0] and out[1].text == "other start" and out[1].n_removed == 1
    # a chunk that crosses the block's edge stays; chunks inside it go
    assert out[2].text == block and out[3].n_removed >= 1 and set(out[3].text.split("\n")) < set(texts[3].split("\n"))
    assert out[4].text == out[5].text == "Of." and out[6].text is None and out[7].text == ""
    assert line_dedup.line_dedup(docs(spark)).count() == len(ODD) + 2 and line_dedup.line_dedup(empty(spark)).count() == 0


def brute(texts, k, num, den):
    sets = {}
    for d, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[d] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {(d, len(sets[d]), find(d)) for d in sets}


@pytest.mark.parametrize(("k", "num", "den"), [(4, 85, 100), (2, 3, 5)])
def test_jaccard(spark, k, num, den):
    rng = random.Random(k)
    base = [" ".join(rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(rng.choice((3, 9, 30, 90)))) for _ in range(25)]
    texts = {}
    for i in range(150):
        w = rng.choice(base).split()
        for _ in range(rng.choice((0, 1, 1, 2, 5))):
            w[rng.randrange(len(w))] = rng.choice("xyz")
        texts[i] = " ".join(w).upper() if i % 9 == 0 else " ".join(w)
    texts |= {200: None, 201: "", 202: "a", 203: "A"}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    assert {tuple(r) for r in jaccard_join.jaccard_components(df, k=k, num=num, den=den).collect()} == brute(texts, k, num, den)


def test_jaccard_odd(spark):
    assert jaccard_join.jaccard_components(docs(spark)).count() == len(ODD) + 2
    assert jaccard_join.jaccard_components(empty(spark)).count() == 0


def test_token_counts(spark):
    tok = token_counts.tokenizer(token_counts.vocabulary())
    want = {i: len(tok.encode(t or "", add_special_tokens=False)) for i, t in enumerate(ODD)}
    got = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(docs(spark, ODD, False), chunk=500, overlap=7).collect()}
    assert got == want
    assert token_counts.count_tokens(empty(spark)).count() == 0


@pytest.mark.parametrize("chunk", [50, 333])
def test_huge_texts(chunk):
    tok = token_counts.tokenizer(token_counts.vocabulary())
    for text in ("it's 42  units\n" * 90, "ab<|endoftext|>'s 1" * 60, "nospace" * 200, "é x" * 200):
        assert token_counts.count_huge(tok, text, chunk, 5) == len(tok.encode(text, add_special_tokens=False))


def test_pieces(spark):
    sentencepiece = pytest.importorskip("sentencepiece")
    import public_tokenizers

    lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    rng = random.Random(5)
    texts = [*[t for t in ODD if t is not None], *["".join(rng.choice("abcdetiou  \n.,é日🙂▁") for _ in range(rng.randint(0, 900))) for _ in range(60)]]
    coded = pieces.encode(docs(spark, texts, False), check=True)
    out = {r.doc_id: r for r in coded.collect()}
    for i, t in enumerate(texts):
        assert out[i].ids == lib.encode(t) and out[i].round_trip
    back = {r.doc_id: r.text for r in pieces.decode(coded.select("doc_id", "ids")).collect()}
    assert all(back[i] == t.replace("▁", " ") for i, t in enumerate(texts))
    assert pieces.encode(docs(spark)).count() == len(ODD) + 2 and pieces.encode(empty(spark)).count() == 0


def test_language_id(spark):
    word = {"aa": "lorem ipsum dolor", "bb": "schnell über straße", "cc": "niño año señor"}
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(word[x].split()) for _ in range(30)), x) for i, x in enumerate(list(word) * 30)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.learn(df.filter("doc_id < 60"))
    out = {r.doc_id: r.lang_pred for r in language_id.identify(df, model).collect()}
    assert all(out[i] == x for i, _, x in rows)
    odd = language_id.identify(docs(spark), model).filter("lang_pred = 'und'").select("doc_id", "score").collect()
    assert {0, 1, 2, 9} == {r.doc_id for r in odd} and {r.score for r in odd} == {0.0}
    assert language_id.learn(empty(spark)) == {} and language_id.identify(empty(spark), {}).count() == 0


def test_decontaminate(spark):
    item = "A farmer bought 12 apples from Maria for 3 dollars and then sold them to his neighbour for 5 dollars each"
    bench = spark.createDataFrame([(1, item), (2, None), (3, "too short"), (4, "")], "item_id long, text string")
    texts = [f"Intro here. {item}. More text follows.", "Intro. " + item.replace("12", "40").replace("Maria", "Jonas").replace("5 dollars", "9 dollars").replace("3 dollars", "7 dollars"), "A farmer bought some land and nothing else happened on that day at all", None, ""]
    out = {(r.doc_id, r.item_id, r.reparameterised) for r in decontaminate.find_leaks(docs(spark, texts, False), bench).collect()}
    assert out == {(0, 1, False), (1, 1, True)}
    assert decontaminate.drop_leaks(docs(spark, texts, False), bench).count() == 3
    assert decontaminate.find_leaks(docs(spark), bench).count() == 0 and decontaminate.find_leaks(empty(spark), bench).count() == 0
    assert decontaminate.find_leaks(docs(spark), bench.limit(0)).count() == 0


def test_slots_have_to_agree(spark):
    item = "then 4 boxes hold 4 books and 4 boxes hold 4 pens in the room"
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    texts = [item.replace("4", "9"), "then 4 boxes hold 5 books and 6 boxes hold 7 pens in the room"]
    assert {r.doc_id for r in decontaminate.find_leaks(docs(spark, texts, False), bench).collect()} == {0}


def test_licenses(spark):
    texts = [f"some text\n{t}\nmore text" for t in license_scan.TEMPLATES.values()] + ["plain text about a license to fish", None, ""]
    out = {(r.doc_id, r.license_id) for r in license_scan.scan_licenses(docs(spark, texts, False)).collect()}
    assert out == set(enumerate(license_scan.TEMPLATES))
    assert license_scan.scan_licenses(docs(spark)).count() == 0 and license_scan.scan_licenses(empty(spark)).count() == 0


def test_warc(spark):
    big = "<p>" + "hällo " * 400
    pages = [(1, "u", big), (2, None, big), (3, "u\nv", "small"), (4, "u", "small"), (5, "u", None), (6, "u", "".join(map(chr, range(1, 3000)))), (None, "u", big)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)
    for split in (64, 1000, 1 << 20):
        out = {r.page_id: r for r in warc.round_trip(df, split_bytes=split).collect()}
        assert len(out) == len(pages)
        for k, _, html in pages:
            raw = (html or "").encode()
            assert (out[k].payload_bytes, out[k].payload_digest) == (len(raw), hashlib.sha1(raw).hexdigest())
        assert (out[1].record_type, out[1].refers_to, out[2].record_type, out[3].record_type) == ("revisit", 2, "response", "response")
        assert bytes(out[6].payload).decode() == pages[5][2]
    assert warc.round_trip(df.limit(0)).count() == 0
