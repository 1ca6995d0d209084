"""Queries over documents' lines against brute force: every line counts, however many a document has."""

import pytest

from tidemark.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def lines(spark):
    """(doc_id, pos, text) of all non-blank lines, made without the engine's views."""
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    return [(r.doc_id, n, t) for r in rows for n, t in enumerate(r.text.split("\n")) if t.strip(" ")]


def test_reading_order_of_all_lines(spark, lines):
    docs = {}
    for d, n, t in lines:
        docs.setdefault(d, []).append((n * 17 % 90, n * 37 % 101, n, len(t) % 5 * 10 + 10))
    want = set()
    for d, boxes in docs.items():
        rows = []  # of (x, pos), with the row's mean centre, count and tallest box
        for y, x, n, h in sorted(boxes):
            centre = y + h / 2
            if rows and abs(centre - mean) <= 0.5 * max(tall, h):
                mean, tall = (mean * len(rows[-1]) + centre) / (len(rows[-1]) + 1), max(tall, h)
                rows[-1].append((x, n))
            else:
                mean, tall = centre, h
                rows.append([(x, n)])
        placed = [(k, n) for k, row in enumerate(rows) for _, n in sorted(row)]
        want |= {(d, n, k, place) for place, (k, n) in enumerate(placed)}
    got = [tuple(r) for r in registry.queries()["q23_ocr_row_order"](spark, SF).select("slide_index", "pos", "row", "place").collect()]
    assert max(n for _, n, _ in lines) >= 12 and len(got) == len(lines) and set(got) == want


def test_markdown_of_all_lines(spark, lines):
    image = lambda d: f"![Slide](img%20{d}%20%281%29.png)"
    letters = lambda t: "".join(c for c in t if c.isalnum())
    want = {}
    for d, n, t in sorted(lines):
        want.setdefault(d, []).append(letters(t) + ("_?_" if (d * 7 + n * 13) % 100 < 60 else ""))
    got = {r.slide_index: r.markdown for r in registry.queries()["q51_fragment_markdown"](spark, SF).collect()}
    assert max(map(len, want.values())) > 5 and got.keys() == want.keys()
    for d, markdown in got.items():
        *parts, last = markdown.split("\n\n")
        assert last == image(d)
        assert [letters(x.removesuffix(" _(?)_")) + "_?_" * x.endswith(" _(?)_") for x in parts] == want[d]
