import random

import numpy as np
import pytest

from seatflow.llm import pieces as P


@pytest.fixture(scope="module")
def vocabulary():
    return P.Vocabulary.load()


def _varint(data, at):
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        shift += 7
        if byte < 128:
            return value, at


def _fields(data):
    """(number, whole field, body) of a serialized message."""
    at = 0
    while at < len(data):
        first = at
        tag, at = _varint(data, at)
        body = None
        if tag & 7 == 0:
            _, at = _varint(data, at)
        elif tag & 7 == 2:
            size, at = _varint(data, at)
            body, at = data[at : at + size], at + size
        else:
            at += {5: 4, 1: 8}[tag & 7]
        yield tag >> 3, data[first:at], body


def _length(n):
    out = b""
    while n > 127:
        out += bytes([n & 127 | 128])
        n >>= 7
    return out + bytes([n])


@pytest.fixture(scope="module")
def library():
    """The public library on the same pieces and scores, told that they are of the unigram kind."""
    import sentencepiece

    out = b""
    for number, whole, body in _fields(open(P.MODEL_PATH, "rb").read()):
        if number == 2:  # trainer spec; its third field is the kind of model
            body = b"".join(b"\x18\x01" if n == 3 else w for n, w, _ in _fields(body))
            whole = b"\x12" + _length(len(body)) + body
        out += whole
    return sentencepiece.SentencePieceProcessor(model_proto=out)


ODD = [
    "日本語テキスト", "aaa", "xxxxxxx", "a b", "  lead", "tab\there", "emoji😀x", "line\nfeed\n\n", "trail  ",
    "", " ", "▁", "a▁b", "<s>", "<0x41>", "\x00", "é" * 9,
]


def test_same_path_as_the_library(vocabulary, library):
    """The best two paths of the library's lattice: ours scores like the first, and is it unless they tie."""
    import duckdb

    texts = duckdb.sql("SELECT text FROM '/root/testdata/sf0.001/documents.parquet' LIMIT 100").fetchall()
    words = sorted({w for (t,) in texts for w in t.split()})[::4] + [w for w in ODD if w]
    memory = P.Memory(vocabulary)
    lowest = vocabulary.unknown

    def score(ids):
        known = sum(vocabulary.scores.get(vocabulary.texts[i], 0.0) for i in ids)
        spelled = bytes(vocabulary.byte_ids.index(i) for i in ids if i in bytes_)
        return known + lowest * len(spelled.decode())

    bytes_ = set(vocabulary.byte_ids)
    for word in words:
        ours = memory.ids_of(P.normalized(word))
        paths = [list(x) for x in library.nbest_encode_as_ids(word, 2)]
        assert score(ours) == score(paths[0]) >= score(library.encode(word))
        if len(paths) < 2 or score(paths[1]) < score(paths[0]):
            assert ours == paths[0]


def texts():
    rng = random.Random(1)
    return [
        "".join(rng.choice("aabbcx") for _ in range(300)), "a" * 133, "=-" * 90, "日" * 50 + "x" * 77, "the " * 60,
        "", None, " " * 90, "\n" * 60, "ü" * 64, "hello world " * 9, "one two three\nfour " * 20,
    ]


@pytest.mark.parametrize("chunk", [17, 40, 1000])
def test_chunks_do_not_change_the_ids(spark, rows, vocabulary, chunk):
    """Chunks down to the length of a piece, with and without places to cut, against one path over the whole."""
    data = [(i, t, [i]) for i, t in enumerate(texts())] + [(3, "the cat sat on the mat", [1]), (None, "null id " * 8, [2])]
    frame = rows(data, "doc_id long, text string, ids array<int>")
    got = P.decode(P.encode(frame, vocabulary, chunk), vocabulary).collect()
    want = []
    for i, text, _ in data:
        _, ends = P.best_path(P.normalized(text or ""), vocabulary)
        starts = [0, *ends[:-1]]
        spelled = [x for a, b in zip(starts, ends) for x in vocabulary.spell(P.normalized(text)[a:b])]
        want.append((i, spelled, text or ""))
    key = lambda r: (r[0] is None, r[0] or 0, r[2])
    assert sorted(((r["doc_id"], r["ids"], r["decoded"]) for r in got), key=key) == sorted(want, key=key)


def test_no_rows(spark, rows, vocabulary):
    assert P.encode(rows([], "doc_id long, text string"), vocabulary).count() == 0


def test_products_are_associative_and_scanned():
    rng = np.random.default_rng(2)
    a, b, c = (np.where(rng.random((6, 4, 4)) < 0.3, -np.inf, rng.integers(-9, 9, (6, 4, 4))).astype(float) for _ in range(3))
    assert (P.max_plus(P.max_plus(a, b), c) == P.max_plus(a, P.max_plus(b, c))).all()
    for n in (1, 2, 5, 6):
        step, want = a[0], [a[0]]
        for m in a[1:n]:
            step = P.max_plus(step[None], m[None])[0]
            want.append(step)
        assert (P.scan(a[:n]) == np.stack(want)).all()


def test_memory_forgets_without_changing_results(vocabulary, monkeypatch):
    monkeypatch.setattr(P, "REMEMBERED", 9)
    words = "one two three four five six seven eight one two nine one".split()
    texts = [P.normalized(" ".join(words[i : i + 4])) for i in range(8)]
    small = P.Memory(vocabulary)
    got = [small.ids_of(t) for t in texts]
    assert len(small) <= 9
    monkeypatch.setattr(P, "REMEMBERED", 10_000)
    large = P.Memory(vocabulary)
    ids, sizes = large.ids(texts)
    assert got == [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])]


def test_vocabularies_that_differ_late_share_no_memory(vocabulary):
    """Of two that differ in one score or id, each has its own."""
    from dataclasses import replace

    last = list(vocabulary.scores)[-1]
    others = [
        replace(vocabulary, scores={**vocabulary.scores, last: -0.5}),
        replace(vocabulary, ids={**vocabulary.ids, last: 3}),
        replace(vocabulary, merges=not vocabulary.merges),
    ]
    assert len({v.fingerprint for v in [vocabulary, *others]}) == 4
    assert P.memory_of(vocabulary) is not P.memory_of(others[0])
    assert P.memory_of(replace(vocabulary)) is P.memory_of(vocabulary)


def test_parts_solved_together_are_solved_alike(vocabulary):
    rng = random.Random(4)
    texts = ["".join(rng.choice("▁abethrs.é") for _ in range(n)) for n in range(1, 30) for _ in range(20)]
    memory = P.Memory(vocabulary)
    memory.learn(set(texts))
    for text in texts:
        score, ends = P.best_path(text, vocabulary)
        n = memory[text]
        found = memory.ids_[memory.starts[n] : memory.starts[n] + memory.sizes[n]].tolist()
        assert found == [x for a, b in zip([0, *ends[:-1]], ends) for x in vocabulary.spell(text[a:b])]
        assert memory.scores[n] == score


def test_decoded_with_the_ids(spark, rows, vocabulary):
    frame = rows([(i, t) for i, t in enumerate(texts())], "doc_id long, text string")
    got = P.encode(frame, vocabulary, 100, decoded=True)
    assert {r["doc_id"]: r["decoded"] for r in got.collect()} == {i: t or "" for i, t in enumerate(texts())}
    spelled = P.decode(rows([(1, None), (2, []), (3, [3 + 0xFF])], "doc_id long, ids array<int>"), vocabulary)
    assert [r["decoded"] for r in spelled.orderBy("doc_id").collect()] == ["", "", ""]


@pytest.fixture(scope="module")
def merging():
    return P.Vocabulary.load(merges=True)


@pytest.fixture(scope="module")
def tokenizer():
    """The public library on the model as it is, which merges."""
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=P.MODEL_PATH)


def test_merges_give_the_ids_of_the_given_tokenizer(merging, tokenizer):
    import duckdb

    given = [t for (t,) in duckdb.sql("SELECT text FROM '/root/testdata/sf0.001/documents.parquet'").fetchall() if t]
    given += [t for t in [*ODD, *texts()] if t]
    memory = P.Memory(merging)
    ids, sizes = memory.ids([P.normalized(t) for t in given])
    assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == tokenizer.encode(given)
    for text in [*ODD, *texts()]:
        if text:
            assert [i for p in P.merged(P.normalized(text), merging) for i in merging.spell(p)] == tokenizer.encode(text)


@pytest.mark.parametrize("chunk", [5, 17, 40, 1000])
def test_chunks_do_not_change_merges(spark, rows, merging, tokenizer, chunk):
    rng = random.Random(6)
    more = ["".join(rng.choice("eethrsan tio") for _ in range(200)) for _ in range(20)] + ["e" * 200, " " * 77 + "x", "-" * 131]
    data = list(enumerate([*texts(), *more]))
    got = P.encode(rows(data, "doc_id long, text string"), merging, chunk, decoded=True).collect()
    assert {r["doc_id"]: r["ids"] for r in got} == {i: tokenizer.encode(t or "") for i, t in data}
    assert {r["doc_id"]: r["decoded"] for r in got} == {i: t or "" for i, t in data}
    assert len(got) == len(data)


def test_query_gives_the_ids_of_the_given_tokenizer(spark, tokenizer):
    from seatflow.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    want = {r["doc_id"]: tokenizer.encode(r["text"] or "") for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert {r["doc_id"]: r["ids"] for r in QUERIES["op8_sentencepiece"](spark, sf).collect()} == want


def test_texts_above_32768_characters_go_through_the_scan(spark, rows, merging, tokenizer, monkeypatch):
    seen, giants = [], P._giants

    def noted(frame, *rest):
        seen.extend(len(r["text"]) for r in frame.collect())
        return giants(frame, *rest)

    monkeypatch.setattr(P, "_giants", noted)
    data = [(i, ("many words " * 6000)[:n]) for i, n in enumerate((32_768, 32_769, 50_000))]
    got = P.encode(rows(data, "doc_id long, text string"), merging).collect()
    assert sorted(seen) == [32_769, 50_000]
    assert {r["doc_id"]: r["ids"] for r in got} == {i: tokenizer.encode(t) for i, t in data}
