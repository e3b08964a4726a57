import hashlib
import random

import numpy as np
import pytest

from nosoflow.llm import pieces

from .conftest import prose

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", " ", "  a", "a  ", "▁", "a▁b ▁▁", "日本語テキスト", "x" * 500, " " * 300, "\x00\t\n", "é́😀 zz", "q" * 70 + " " + "ab " * 50]


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.Pieces(PATH)


def slow(vocabulary, encoder, text, doc_id):
    """Merge the best candidate again and again, over the whole text."""
    mask = (1 << 64) - 1

    def mixed(value):
        return int(pieces.mixed(np.array([value & mask], np.uint64))[0])

    key = mixed((encoder.seed * 0x9E3779B97F4A7C15 + doc_id) & mask)
    segments, current = [], ""
    for i, char in enumerate(" " + text):
        if char == " " and i and (" " + text)[i - 1] != " ":
            segments.append(current)
            current = ""
        current += char
    out = []
    for number, segment in enumerate([*segments, current]):
        owner = mixed(key + number)
        symbols = [(i, {" ": "▁", "▁": None}.get(c, c)) for i, c in enumerate(segment)]
        while True:
            best = None
            for n in range(len(symbols) - 1):
                (place, left), (_, right) = symbols[n], symbols[n + 1]
                if left is None or right is None or left not in vocabulary.id or right not in vocabulary.id:
                    continue
                merged = vocabulary.id.get(left + right)
                if merged is None:
                    continue
                if encoder.limit and mixed(owner + place * int(pieces._PLACE) + merged * int(pieces._PIECE)) < int(encoder.limit):
                    continue
                rank = int(vocabulary.rank[merged])
                if best is None or rank < best[0]:
                    best = (rank, n, left + right)
            if best is None:
                break
            n = best[1]
            symbols[n:n + 2] = [(symbols[n][0], best[2])]
        for place, symbol in symbols:
            if symbol in vocabulary.id:
                out.append(vocabulary.id[symbol])
            else:
                out += [vocabulary.byte_id[b] for b in segment[place].encode()]
    return out


@pytest.mark.parametrize("dropout", [0.0, 0.1, 0.5])
def test_equals_the_slow_search(vocabulary, dropout):
    encoder = pieces.Encoder(vocabulary, dropout, seed=3)
    texts = [prose(i, 25) for i in range(5)] + [t for t in ODD if t and len(t) < 100]
    for i, ids in enumerate(encoder.encode_all(texts, list(range(len(texts))))):
        assert ids.tolist() == slow(vocabulary, encoder, texts[i], i), texts[i]


def test_without_dropout_ids_are_the_librarys(vocabulary):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    encoder = pieces.Encoder(vocabulary, 0.0)
    for i, text in enumerate([prose(9, 300), *(t for t in ODD if "▁" not in t)]):
        assert encoder.encode(text, i).tolist() == library.encode(text)


def test_decoding_is_lossless_and_seeds_differ(vocabulary):
    rnd = random.Random(1)
    texts = [*ODD, *("".join(rnd.choice("ab ▁é日😀\n") for _ in range(200)) for _ in range(30)), prose(5, 400)]
    counts = []
    for dropout, seed in ((0.0, 1), (0.2, 1), (0.2, 2), (1.0, 1)):
        encoder = pieces.Encoder(vocabulary, dropout, seed)
        ids = encoder.encode_all(texts, list(range(len(texts))))
        assert [encoder.decode(x) for x in ids] == texts
        counts.append([x.tolist() for x in ids])
    assert counts[1] != counts[2] and len(counts[0][-1]) < len(counts[1][-1]) < len(counts[3][-1])


def test_a_texts_ids_don_t_depend_on_its_company_or_the_batch(vocabulary, monkeypatch):
    encoder = pieces.Encoder(vocabulary, 0.3)
    texts = [prose(i, 60) for i in range(8)] + ["y" * 300]
    together = encoder.encode_all(texts, list(range(9)))
    monkeypatch.setattr(pieces, "BATCH_CHARS", 50)
    monkeypatch.setattr(pieces, "WIDTHS", (4, 8))
    assert all((a == encoder.encode(t, i)).all() for i, (a, t) in enumerate(zip(together, texts)))


def test_awkward_rows(spark, awkward, empty):
    rows = pieces.round_trip(awkward, PATH).collect()
    assert len(rows) == awkward.count() and all(r.lossless for r in rows)
    digests = sorted(hashlib.sha256((d.text or "").encode()).hexdigest() for d in awkward.collect())
    assert sorted(r.decoded_sha256 for r in rows) == digests
    assert [(r.n_tokens, r.ids_crc32) for r in rows if r.doc_id in (1, 2)] == [(0, 0)] * 2
    assert len({(r.ids_crc32, r.n_tokens) for r in rows if r.doc_id == 6}) == 1
    assert pieces.round_trip(empty, PATH).collect() == []
    decoded = pieces.decode_documents(pieces.encode_documents(awkward, PATH), PATH).collect()
    assert sorted(str((r.doc_id, r.text)) for r in decoded) == sorted(str((d.doc_id, d.text or "")) for d in awkward.collect())
