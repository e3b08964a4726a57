import zlib

import numpy as np
import pytest

from nosoflow.llm import common, tokens

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")


def expected(rows):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(PATH)
    out, start = [], 0
    for doc_id, text in sorted(((r.doc_id, r.text or "") for r in rows), key=lambda x: (x[0] is not None, x[0] or 0, x[1])):
        ids = [*tokenizer.encode(text, add_special_tokens=False).ids, 0]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def key(row):
    return str(row)


def test_files_hold_the_tokenizers_ids(spark, awkward):
    folder = common.scratch(spark, "t")
    got = tokens.stream(spark, awkward, folder, PATH, part_bytes=1000, sequence=64)
    assert sorted((tuple(r)[:4] for r in got.collect()), key=key) == sorted(expected(awkward.collect()), key=key)


def test_empty_table(spark, empty):
    assert tokens.stream(spark, empty, common.scratch(spark, "t"), PATH).collect() == []


def test_sequences_are_views_of_equal_length(spark, awkward):
    folder = common.scratch(spark, "t")
    manifest = tokens.write_token_files(awkward, folder, PATH, sequence=32)
    total = 0
    for name, n_docs, n_tokens in manifest:
        file = tokens.SequenceFile(f"{tokens._filesystem(folder)[1]}/{name}")
        masks = [file[i][1].true_count for i in range(len(file))]
        assert all(len(x) == 32 for i in range(len(file)) for x in file[i]) and not file[0][0].flags.owndata
        assert sum(masks) == n_tokens and set(masks[:-1]) <= {32}
        assert sum(file[i][2].true_count for i in range(len(file))) == n_docs
        total += n_tokens
        with pytest.raises(IndexError):
            file[len(file)]
    assert total == sum(x[2] for x in expected(awkward.collect()))


def test_special_tokens_in_texts_are_those_of_the_library(spark, make_docs):
    from tokenizers import Tokenizer

    docs = make_docs([(1, "a <|endoftext|> b"), (2, "<|endoftext|>")])
    for option in (False, True):
        whole = Tokenizer.from_file(PATH)
        whole.encode_special_tokens = option
        got = tokens.stream(spark, docs, common.scratch(spark, "t"), PATH, special_as_text=option).orderBy("doc_id").collect()
        assert [r.n_tokens for r in got] == [len(whole.encode(r.text, add_special_tokens=False).ids) + 1 for r in docs.collect()]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
@pytest.mark.parametrize("special_as_text", [False, True])
def test_pieces_equal_the_whole_text(name, special_as_text):
    from tokenizers import Tokenizer

    path = public_tokenizers.path(name)
    encoder, whole = tokens.Encoder(path, limit=5, special_as_text=special_as_text), Tokenizer.from_file(path)
    whole.encode_special_tokens = special_as_text
    assert tokens.cut_by_split(path) == (name == "byte_bpe_50k.json")
    for text in ["a <|endoftext|> b", "<|endoftext|><|startoftext|>x", "Plain English text, with CAPITALS and it's end.","", "I've  done\n\n it's 12½ ²x", "a_b __ c's 'll 're!! '", "  x \x1c y", "żółć 東京 naïve café", "\n \n  \n", "x" * 300, "<|endoftext|> a"]:
        assert encoder.count(text) == len(encoder.encode(text))
        assert encoder.encode(text).tolist() == whole.encode(text, add_special_tokens=False).ids, text


def test_batches_have_the_same_length_in_bytes(spark, make_docs):
    """So that the place of a sequence follows from its number."""
    import pyarrow as pa

    docs = make_docs([(i, "word " * 3000) for i in range(40)])
    folder = common.scratch(spark, "t")
    manifest = tokens.write_token_files(docs, folder, PATH, sequence=64, part_bytes=1 << 40)
    for name, _, _ in manifest:
        with open(f"{tokens._filesystem(folder)[1]}/{name}", "rb") as source:
            reader, ends = pa.ipc.open_stream(source), []
            for _ in reader:
                ends.append(source.tell())
        steps = np.diff(ends[:-1])
        assert len(set(steps.tolist())) <= 1
    assert len(manifest) > 0
