"""The rare-token index against reading every alignment, whatever words the corpus makes rare."""

from __future__ import annotations

import random
import re

import pytest

from marram.llm import licences

from .test_operators import docs_of, prose


def plain_labels(text):
    """Labels and best score by trying every template at every place."""
    up = dict(zip(map(ord, licences._UP), licences._LOW, strict=True))
    words = [w.translate(up) for w in re.findall(licences.WORD, text or "")]
    found = {}
    for label, own, first, size in licences.TEMPLATE_WORDS:
        for at in range(-len(own), len(words)):
            right = [0 <= at + p < len(words) and words[at + p] == w for p, w in enumerate(own)]
            if all(right[first : first + size]) and sum(right) / len(own) >= licences.COVER:
                found[label] = max(found.get(label, 0.0), sum(right) / len(own))
    base = {label for phrase, label in licences.PHRASES for i in range(len(words)) if tuple(words[i : i + len(phrase)]) == phrase}
    return base, set(found), 1.0 if base else max(found.values(), default=0.0)


@pytest.mark.parametrize("seed", [1, 2])
def test_labels_equal_trying_every_place(spark, seed):
    r = random.Random(seed)
    texts = [t.replace("|", " ") for _, t in licences.TEMPLATES]
    rows, alone = [(0, None), (1, "")], 0
    for i in range(2, 160):
        parts = []
        for _ in range(r.randint(1, 3)):
            words = r.choice(texts).split()
            for _ in range(r.choice((0, 0, 1, 2, 6))):
                words[r.randrange(len(words))] = r.choice(("word", "license", "software", "the"))
            if r.random() < 0.3:
                del words[r.randrange(len(words))]
            parts += [prose(r, r.randint(0, 8)), r.choice((" ", ", ", "\n * ")).join(words), "license software public granted " * r.randint(0, 3)]
        rows.append((i, " ".join(parts).upper() if r.random() < 0.2 else " ".join(parts)))
    # Common words of one corpus are rare in another.
    rows += [(1000 + i, r.choice(("hereby granted redistribute eclipse mozilla", "public license software free")) + f" x{i}") for i in range(80)]
    got = {x["doc_id"]: (x["base_labels"], x["labels"], x["score"]) for x in licences.scan(docs_of(spark, rows)).collect()}
    for i, text in rows:
        base, more, score = plain_labels(text)
        assert got[i] == (",".join(sorted(base)), ",".join(sorted(base | more)), pytest.approx(score)), text
        alone += bool(more - base)
    assert alone > 60


def test_the_index_posts_the_words_that_few_files_hold(spark):
    rows = [(i, "permission is hereby granted, Permission again") for i in range(5)] + [(9, "any person obtaining a copy; PUBLIC license"), (10, None)]
    frequency = licences.document_frequency(docs_of(spark, rows))
    assert frequency["permission"] == frequency["granted"] == 5 and frequency["obtaining"] == frequency["public"] == 1
    index = licences.rare_index(frequency)
    for t, (_, words, first, size) in enumerate(licences.TEMPLATE_WORDS):
        own = [(w, p) for w, ps in index.items() for k, p in ps if k == t]
        assert len(own) == licences.RAREST and all(words[p] == w and first <= p < first + size for w, p in own)
        worst = max(frequency.get(w, 0) for w, _ in own)
        assert all(frequency.get(words[p], 0) >= worst for p in range(first, first + size) if (words[p], p) not in own)
    assert licences.rare_index({}) and licences.document_frequency(docs_of(spark, [])) == {}
