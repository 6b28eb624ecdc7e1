from plexframe.llm import license_scan


def brute(text):
    """License and containment, over the windows that the scan states."""
    grams = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    words, out = license_scan.words_of(text), set()
    for name, t in license_scan.TEMPLATES.items():
        own = license_scan.words_of(t)
        stride, want = max(1, len(own) // 4), grams(own)
        best = max(len(want & grams(words[i : i + len(own) + stride - 1])) / len(want) for i in range(0, len(words), stride))
        if best >= 0.8:
            out.add((name, round(best, 6)))
    return out


def test_notices_that_lost_words(spark):
    texts = []
    for t in license_scan.TEMPLATES.values():
        words = t.split()
        for n in range(len(words) // 2, len(words) + 1):
            texts += [" ".join(words[:n]), " ".join(words[-n:]), "some other words before it\n" + " ".join(words[:n]) + "\nand some after it"]
    found = {}
    for r in license_scan.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect():
        found.setdefault(r.doc_id, set()).add((r.license_id, round(r.containment, 6)))
    assert {i: found.get(i, set()) for i in range(len(texts))} == {i: brute(t) for i, t in enumerate(texts)}


def test_related_licenses(spark):
    names = ["agpl-header", "lgpl-header", "epl-2.0", "cc-by-sa-4.0"]
    rows = [(i, f"x\n{license_scan.TEMPLATES[n]}\ny") for i, n in enumerate(names)]
    out = license_scan.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.license_id) for r in out} == set(enumerate(names))
