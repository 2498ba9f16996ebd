"""Encoding against the library, whole and in a stream, and back."""

import os
import random

import pytest

from arcweave.llm.queries import MODEL
from arcweave.llm.sp_codec import Codec, decode_documents, encode_documents

pytestmark = pytest.mark.skipif(not os.path.exists(MODEL), reason="no model here")


@pytest.fixture(scope="module")
def codec():
    return Codec.load(MODEL)


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def texts():
    rng = random.Random(1)
    out = ["Hello world", "  a  b ", "é ñ 漢字 \n\t x", "\u3000x", "a\x00b", " ", "   ", "a" * 300, "ab" * 2000, "  " * 50 + "x", "x,\ny.", "don't (e.g.) $5.00/a_b", "😀😀 x"]
    out += ["".join(rng.choice("abcdeé \n漢'.,the ingon") for _ in range(rng.randint(1, 200))) for _ in range(300)]
    return out + ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(100, 3000))) for _ in range(40)]


def test_ids_equal_the_library(codec, library):
    for t in texts():
        ids = codec.encode(t).tolist()
        assert ids == library.encode(t) and codec.decode(ids) == library.decode(ids) == t


def test_the_stream_equals_the_whole(codec, library):
    for t in texts():
        assert list(codec.stream(("▁" + t).replace(" ", "▁"))) == library.encode(t)


def test_runs_of_spaces_go_through_the_stream(codec, library):
    """Their pieces have equal scores, among which places decide."""
    rng = random.Random(3)
    for t in [" " * n for n in range(300)] + [" " * 5000 + "x"] + ["".join(" " * rng.randint(0, 40) + rng.choice(["a", "the", "\n", ",", "é", "漢"]) for _ in range(30)) for _ in range(200)]:
        assert list(codec.stream(("▁" * bool(t) + t).replace(" ", "▁"))) == library.encode(t) == codec.encode(t).tolist()


def test_the_stream_gives_ids_before_the_end(codec):
    text = "▁" + "the▁of▁and▁".replace("▁", "x") * 5000
    seen, source = 0, codec.stream(text)
    for _ in range(100):
        next(source)
        seen += 1
    assert seen == 100


def test_unigram_search_is_the_best_of_all():
    rng = random.Random(0)
    pieces = ["a", "b", "c", "ab", "bc", "abc", "ca", "cab", "▁"]
    scores = [-rng.random() * 5 for _ in pieces]
    codec = Codec(["<unk>", *pieces], [0.0, *scores], ["unknown", *["normal"] * len(pieces)], bpe=False)
    score = dict(zip(pieces, scores, strict=True)) | {"?": min(scores) - 10}

    def best(t):
        if not t:
            return 0.0
        return max(score[p] + best(t[len(p) :]) for p in [*pieces, "?"] if t.startswith(p))

    for _ in range(100):
        t = "".join(rng.choice("abc?") for _ in range(rng.randint(1, 12)))
        got = list(codec.stream(t))
        assert abs(sum(codec.scores[i] if i else score["?"] for i in got) - best(t)) < 1e-9
    long = "".join(rng.choice("abc") for _ in range(2000))
    value = [0.0]
    for i in range(1, len(long) + 1):
        value.append(max(value[i - len(p)] + score[p] for p in pieces if long[:i].endswith(p) and i >= len(p)))
    assert abs(sum(codec.scores[i] for i in codec.stream(long)) - value[-1]) < 1e-6


def test_documents_and_back(spark):
    rows = [(1, None), (2, ""), (3, "▁"), (4, "x " * 50_000), (None, "null id"), (5, "same"), (5, "same")] + [(10 + i, t) for i, t in enumerate(texts()[:40])]
    df = spark.createDataFrame([(*r, 7, [1]) for r in rows], "doc_id long, text string, n_ids int, ids array<int>")
    out = encode_documents(df, MODEL)
    got = out.collect()
    assert len(got) == len(rows) and all(r.n_ids == len(r.ids) for r in got)
    assert [r.round_trip for r in got if r.doc_id == 3] == [False] and all(r.round_trip for r in got if r.doc_id != 3)
    back = {r.doc_id: r.text for r in decode_documents(out, MODEL).collect()}
    assert back[1] == back[2] == "" and back[4] == "x " * 50_000 and back[None] == "null id"
    assert encode_documents(df.limit(0), MODEL).count() == 0


def test_packed_ids_are_the_listed_ones_and_give_the_texts_again(spark):
    rows = [(1, None), (2, ""), (3, "▁"), (4, "x " * 5_000), (None, "null id"), (5, "same"), (5, "same")] + [(10 + i, t) for i, t in enumerate(texts())]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    packed, listed = encode_documents(df, MODEL, packed=True, check=False), encode_documents(df, MODEL)
    assert packed.columns == ["doc_id", "n_ids", "ids"] and packed.schema["ids"].dataType.simpleString() == "binary"
    key = lambda r: (r.doc_id is None, r.doc_id or 0)
    for p, x in zip(sorted(packed.collect(), key=key), sorted(listed.collect(), key=key), strict=True):
        assert (p.doc_id, p.n_ids, memoryview(bytes(p.ids)).cast("i").tolist()) == (x.doc_id, x.n_ids, x.ids)
    back = {i: t or "" for i, t in rows if i != 3}
    for coded in (packed, listed):
        assert {r.doc_id: r.text for r in decode_documents(coded, MODEL).collect() if r.doc_id != 3} == back
    nulls = spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>")
    assert {r.doc_id: r.text for r in decode_documents(nulls, MODEL).collect()} == {1: None, 2: ""}
