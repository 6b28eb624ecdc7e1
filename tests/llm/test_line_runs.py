import random

import pytest

from plexframe.llm import line_dedup


def brute(texts):
    """The texts less every line of a pair, or long line, that stood before."""
    seen, out = set(), {}
    for d, t in sorted(texts.items()):
        lines, gone = t.split("\n"), set()
        full = [i for i, x in enumerate(lines) if x.strip()]
        spans = sorted([*zip(full, full[1:]), *[(i, i) for i in full if lines[i].count(" ") >= 50]])
        for a, b in spans:
            body = "\n".join(lines[a : b + 1])
            if body in seen:
                gone.update(range(a, b + 1))
            seen.add(body)
        out[d] = "\n".join(x for i, x in enumerate(lines) if i not in gone)
    return out


def frame(spark, texts):
    return spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)


@pytest.mark.parametrize(("lines", "words"), [(3, 20), (4, 15), (6, 10), (8, 12), (20, 15)])
def test_planted_passages(spark, lines, words):
    rng = random.Random(lines)
    line = lambda n: " ".join(f"w{rng.randrange(10**9)}" for _ in range(n))
    blocks = [[line(words) for _ in range(lines)] for _ in range(20)]
    texts, own = {}, {}
    for i in range(80):
        head, tail = [line(7) for _ in range(rng.randint(0, 3))], [line(7) for _ in range(rng.randint(0, 3))]
        texts[i], own[i] = "\n".join(head + blocks[i % 20] + tail), "\n".join(head + tail)
    out = {r.doc_id: r for r in line_dedup.line_runs(frame(spark, texts)).collect()}
    for i in range(80):
        assert out[i].text == (texts[i] if i < 20 else own[i]) and out[i].n_removed == (0 if i < 20 else lines)


def test_against_brute_force(spark):
    rng = random.Random(8)
    words = ["a", "b", "c", "d", "", " ", "long " * 51, "e f"]
    texts = {i: "\n".join(rng.choice(words) + rng.choice(["", str(rng.randrange(9))]) for _ in range(rng.randint(1, 9))) for i in range(60)}
    texts |= {100: "", 101: "only\n\n", 102: "only\n\n", 103: "p\n\nq", 104: "x\np\n\nq\ny"}
    got = {r.doc_id: r.text for r in line_dedup.line_runs(frame(spark, texts)).collect()}
    assert got == brute(texts) and got[102] == "only\n\n" and got[104] == "x\ny"
    assert {x for t in got.values() for x in t.split("\n") if x.strip()} == {x for t in texts.values() for x in t.split("\n") if x.strip()}


def test_odd_rows(spark):
    rows = [(1, "a\nb"), (1, "a\nb"), (2, None), (None, "a\nb"), (3, "a\nb"), (3, "c\nd")]
    out = line_dedup.line_runs(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r.doc_id or 0, r.text, r.n_removed) for r in out.collect() if r.text is not None) == [(0, "a\nb", 0), (1, "a\nb", 0), (1, "a\nb", 0), (3, "", 2), (3, "c\nd", 0)]
    assert line_dedup.line_runs(spark.createDataFrame([], "doc_id long, text string")).count() == 0
