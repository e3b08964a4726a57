import random

import numpy as np
import pytest

from nosoflow.llm import licenses
from nosoflow.llm.common import shingles, word_hashes, words

from .conftest import prose


def brute(scanner, text):
    """Best containment over all windows of each template's size."""
    hashes, out = word_hashes(text), []
    grams = shingles(hashes, scanner.words) if len(hashes) >= scanner.words else hashes[:0]
    for i, name in enumerate(scanner.names):
        if i in scanner.short:
            n = scanner.short[i]
            share = float(len(hashes) >= n and (shingles(hashes, n) == scanner.sets[i][0]).any())
        else:
            size = max(4, 1 << (2 * len(scanner.sets[i]) - 1).bit_length())
            share = max([len(np.intersect1d(grams[a:a + size], scanner.sets[i])) / len(scanner.sets[i]) for a in range(0, len(grams), size // 2)], default=0.0)
        if share >= scanner.containment:
            out.append((name, round(share, 9)))
    return out


def found(scanner, texts):
    return [[(m[0], round(m[1], 9)) for m in row] for row in scanner.scan_all(texts)]


def test_equals_search_over_all_windows():
    scanner = licenses.Scanner({**licenses.TEMPLATES, "short": "all rights reserved", "none": "!!"})
    rnd = random.Random(4)
    texts = ["", "mit", "x " * 20_000 + licenses.TEMPLATES["BSD"]]
    for k in range(150):
        words = rnd.choice(list(scanner.names))
        words = ("All Rights Reserved" if words == "short" else licenses.TEMPLATES[words]).split()
        for _ in range(rnd.choice([0, 0, 1, 2])):
            words[rnd.randrange(len(words))] = "changed"
        texts.append(prose(k, rnd.randrange(120)) + " " + " ".join(words) + "\n" + prose(k + 1000, rnd.randrange(120)))
    assert found(scanner, texts) == [brute(scanner, t) for t in texts]


def test_a_text_is_scanned_alike_in_any_company():
    scanner = licenses.Scanner(licenses.TEMPLATES)
    texts = [prose(i, 30 * i % 200) + " " + licenses.TEMPLATES["ISC"] + " " + prose(i, 9) for i in range(20)]
    together = scanner.scan_all(texts)
    assert together == [scanner.scan(t) for t in texts] and together != [[]] * 20
    name, share, first, count = scanner.scan(texts[3])[-1]
    assert (name, share) == ("ISC", 1.0) and words(texts[3])[first:first + count] == words(licenses.TEMPLATES["ISC"])


def test_the_number_of_bands_follows_from_the_chance_of_a_miss():
    for miss in (0.1, 1e-3, 1e-6):
        bands = licenses.bands_for(0.8, miss)
        assert (1 - 0.8 / 4) ** bands <= miss < (1 - 0.8 / 4) ** (bands - 1)


def test_awkward_rows(spark, awkward, empty, make_docs):
    assert licenses.scan_documents(empty).collect() == []
    assert licenses.scan_documents(awkward).collect() == []
    docs = make_docs([(1, licenses.TEMPLATES["MIT"]), (1, licenses.TEMPLATES["MIT"]), (None, "Released under the MIT license!"), (2, None)])
    rows = sorted((str(r.doc_id), r.license, r.containment, r.first_word) for r in licenses.scan_documents(docs).collect())
    assert rows == [("1", "MIT", 1.0, 0), ("1", "MIT", 1.0, 0), ("None", "MIT notice", 1.0, 0)]


def test_too_many_templates(awkward, monkeypatch):
    monkeypatch.setattr(licenses, "MAX_TEMPLATES", 3)
    with pytest.raises(ValueError, match="templates"):
        licenses.scan_documents(awkward)
