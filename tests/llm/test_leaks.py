import pytest

from plexframe.llm import decontaminate

STORY = "Then a clerk counted 48 parcels for Betty before lunch and sent half as many to Betty after lunch so how many parcels did the clerk handle for Betty on that day in total"


def frame(spark, texts, key="doc_id"):
    return spark.createDataFrame(list(enumerate(texts)), f"{key} long, text string")


def found(spark, texts, items):
    out = decontaminate.find_leaks(frame(spark, texts), frame(spark, items, "item_id")).collect()
    return {(r.doc_id, r.item_id): r for r in out}


@pytest.fixture(scope="module")
def items(spark):
    return [r.text for r in spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet").orderBy("item_id").collect()]


def host(words):
    return "some words that stand before it\n" + (words if isinstance(words, str) else " ".join(words)) + "\nand others that stand after it"


def test_edited_copies(spark, items):
    split = [t.split() for t in items]
    edits = {
        "copy": [host(t) for t in items],
        "inserted": [host([*w[: len(w) // 2], "besides", *w[len(w) // 2 :]]) for w in split],
        "dropped": [host([*w[: len(w) // 2], *w[len(w) // 2 + 1 :]]) for w in split],
        "changed": [host([*w[: len(w) // 2], "besides", *w[len(w) // 2 + 1 :]]) for w in split],
    }
    for name, texts in edits.items():
        out = found(spark, texts, items)
        missed = [i for i in range(len(items)) if (i, i) not in out]
        assert not missed, (name, missed)
        assert all(i == j for i, j in out), name


def test_longer_names_and_units(spark):
    texts = [STORY.replace("Betty", "Mary Ann").replace("48", "1,250"), STORY, STORY.replace("for Betty before", "for Mary Ann before")]
    out = found(spark, [host(t) for t in texts], [STORY])
    assert {k: r.reparameterised for k, r in out.items()} == {(0, 0): True, (1, 0): False, (2, 0): out[2, 0].reparameterised}
    assert out[0, 0].n_matched == out[0, 0].n_windows
    trip = "they drove 12 km along the river and walked 3 km back to the old house near the bridge"
    assert set(found(spark, [trip.replace("12 km", "40km"), trip.replace("12 km", "12 miles")], [trip])) >= {(0, 0)}


def test_a_part_is_no_copy(spark):
    words = STORY.split()
    assert not found(spark, [" ".join(words[:12]), " ".join(words[14:24]), " ".join(sorted(words))], [STORY])


def test_case_does_not_hide_a_copy(spark, items):
    for change in (str.upper, str.lower, str.title):
        out = found(spark, [host(change(t)) for t in items], items)
        assert {(i, i) for i in range(len(items))} == set(out), change
    dense = "What did Anna Berg, Otto Lund, Rita Holm, 12 Finns, 40 Swedes and Olaf Strand tell Karl Dahl?"
    assert set(found(spark, [host(dense), host(dense.upper())], [dense])) == {(0, 0), (1, 0)}


def test_names_that_begin_a_sentence(spark):
    item = "Tom has 12 apples and 5 oranges. Tom gives 3 apples to Mary and eats 2 oranges. Mary then gives Tom 4 pears. How many pieces of fruit does Tom have now?"
    other = item
    for x, y in (("Tom", "Hugo"), ("Mary", "Lena"), ("12", "31"), ("5", "17"), ("3", "6"), ("2", "8"), ("4", "9")):
        other = other.replace(x, y) if x.isalpha() else other.replace(f" {x} ", f" {y} ")
    out = found(spark, [host(item), host(other)], [item])
    assert {k: r.reparameterised for k, r in out.items()} == {(0, 0): False, (1, 0): True}
