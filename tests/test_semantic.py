"""Semantic chunks against fixtures and a plain second version."""

import random
import re

from corpusloom.operators import semantic


def paragraph(label, terms):
    return " ".join([f"{label} {terms} explains a coherent mechanism and its supported consequences."] * 4)


VALLEY = "\n\n".join(
    [paragraph("Vectors", "basis dimension linear algebra"), paragraph("Matrices", "basis transformation linear algebra"),
     paragraph("Reactions", "atoms bonds chemical stoichiometry"), paragraph("Molecules", "atoms bonds chemical compounds")]
)


def plain_spans(found, likeness, most, least, overlap, threshold):
    """The same cuts, one unit after the other."""
    spans, start = [], 0
    while start < len(found):
        room = most if start == 0 else max(200, most - overlap)
        end, size, places = start, 0, []
        while end < len(found):
            more = len(found[end][0]) + (2 if end > start else 0)
            if end > start and size + more > room:
                break
            size, end = size + more, end + 1
            if end < len(found) and size >= least:
                places.append(end)
        if end == len(found):
            return [*spans, (start, end, "section_end", None)]
        safe = [p for p in places if not found[p - 1][1] and not found[p][1]]
        order = sorted(likeness[p - 1] for p in safe)
        good = [p for p in safe if likeness[p - 1] <= threshold or likeness[p - 1] <= order[len(order) // 2] - 0.08]
        if good:
            best = min(likeness[p - 1] for p in good)
            cut = max(p for p in good if likeness[p - 1] == best)
        else:
            cut = safe[-1] if safe else places[-1] if places else end
        spans.append((start, cut, "semantic" if good else "size", likeness[cut - 1]))
        start = cut
    return spans


def test_cuts_equal_the_plain_version():
    rng = random.Random(1)
    for _ in range(2000):
        found = [("x" * rng.choice([1, 20, 90, 180, 400]), rng.random() < 0.2) for _ in range(rng.randrange(1, 25))]
        likeness = [rng.choice([0.0, 0.05, 0.1, 0.3, 0.5, 0.9]) for _ in found[1:]]
        size = rng.choice([(300, 100, 50, 0.12), (600, 200, 180, 0.72), (250, 0, 0, 0.0)])
        assert semantic.cuts(found, likeness, *size) == plain_spans(found, likeness, *size)


def test_valley_of_vectors(spark):
    vectors = [(1, k, v) for k, v in enumerate(([1.0, 0.0], [0.99, 0.01], [0.0, 1.0], [0.01, 0.99]))]
    docs = spark.createDataFrame([(1, VALLEY), (2, None), (3, " \n "), (4, "short"), (5, VALLEY)], "doc_id bigint, text string")
    v = spark.createDataFrame(vectors, "doc_id bigint, unit int, embedding array<double>")
    got = [r for r in semantic.semantic_chunks(docs, v, 1100, 300, 100, 0.72).orderBy("doc_id", "chunk").collect()]
    one = [r for r in got if r.doc_id == 1]
    assert [r.boundary for r in one] == ["semantic", "section_end"]
    assert "Matrices" in one[0].text and "Reactions" not in one[0].text and "Reactions" in one[1].text
    assert [(r.doc_id, r.text) for r in got if r.doc_id in (2, 3, 4)] == [(4, "short")]
    assert [r.doc_id for r in got].count(5) >= 2  # no vectors: by terms
    assert [r.unit for r in semantic.semantic_units(docs).where("doc_id = 1").collect()] == [0, 1, 2, 3]


def test_structured_units_stay_with_their_neighbours():
    text = "\n\n".join([paragraph("Force", "mass acceleration Newtonian mechanics"), "$$F = ma$$", paragraph("Motion", "mass acceleration Newtonian mechanics"), paragraph("Cells", "membrane nucleus biological tissue")])
    made = semantic.chunked(text, [0.05, 0.05, 0.10], 900, 250, 80, 0.72)
    whole = next(t for t, _, _ in made if "F = ma" in t)
    assert "Force" in whole and "Motion" in whole and "Cells" not in whole
    assert semantic.structured("| a | b |\n| - | - |") and semantic.structured("```\nx\n```") and not semantic.structured("| a |")


def test_oversize_prose_keeps_every_word():
    text = " ".join(f"token{i}" for i in range(500)) + " LAST"
    found = semantic.units(text, 320)
    assert len(found) > 1 and all(len(t) <= 320 for t, _ in found)
    assert " ".join(t for t, _ in found).split() == text.split()
    hard = semantic.units("y" * 100_000 + " z", 300)
    assert all(len(t) <= 300 for t, _ in hard) and "".join(t for t, _ in hard).replace("\n", "").replace(" ", "") == "y" * 100_000 + "z"


def test_chunks_keep_every_unit_and_their_size():
    rng = random.Random(2)
    words = [f"w{k}" for k in range(40)]
    for _ in range(200):
        parts = [" ".join(rng.choices(words, k=rng.choice([3, 30, 300]))) + rng.choice([".", "", "!\nMore."]) for _ in range(rng.randrange(1, 12))]
        parts.insert(rng.randrange(len(parts)), "| a | b |\n|---|---|\n| 1 | 2 |")
        text = "\n\n".join(parts)
        made = semantic.chunked(text, None, 600, 200, 120, 0.72)
        bodies, at = re.sub(r"\s+", "", text), 0
        for chunk, _, _ in made:
            solid = re.sub(r"\s+", "", chunk)
            while solid and not bodies.startswith(solid, at):  # a lead of earlier sentences comes first
                solid = solid[1:]
            at += len(solid)
            assert len(chunk) <= 600 or "|" in chunk
        assert at == len(bodies)
