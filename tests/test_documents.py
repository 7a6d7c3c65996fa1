"""Front matter, chunk rules and the directory source."""

import random

from pyspark.sql import functions as F

from seatflow.operators.chunking import chunk
from seatflow.operators.chunking import pack as windows
from seatflow.operators.encoding import embed_with, letter_encoder
from seatflow.schemas import KNOWLEDGE_CHUNKS
from seatflow.sources.documents import build_chunk_table, build_chunks, read_documents, split_front_matter

DOC = """---
source_url: https://example.com/a:b
policy_year: 2026
canonical_source: "MOE"
topic:
---

# Title

Body text.
"""


def test_front_matter(rows):
    df = rows([("a.md", DOC), ("b.md", "no fence"), ("c.md", "--- open"), ("d.md", "---\n---\n ")],
              "source_file string, text string")
    got = {r.source_file: r for r in split_front_matter(df).collect()}
    a = got["a.md"]
    assert (a.topic, a.source_url, a.policy_year, a.canonical_source) == (
        None, "https://example.com/a:b", "2026", "MOE",
    )
    assert a.text == "# Title\n\nBody text."
    assert got["b.md"].text == "no fence" and got["b.md"].topic is None
    assert got["c.md"].text == "--- open"
    chunks = {r.source_file: r for r in build_chunks(df, "policy").collect()}
    assert "d.md" not in chunks and chunks["a.md"].topic == "a"
    assert chunks["a.md"].policy_year == 2026


def test_front_matter_that_repeats_and_comments(rows):
    text = """---
topic: first
policy_year: 2026 # checked
canonical_source: "a # b" # not this
source_url: https://example.com/#top
topic: last
---
body"""
    got = split_front_matter(rows([("a.md", text)], "source_file string, text string")).first()
    assert (got.topic, got.policy_year, got.canonical_source, got.source_url, got.text) == (
        "last", "2026", "a # b", "https://example.com/#top", "body",
    )


def test_chunk_table(spark, rows, tmp_path):
    docs = rows([("a.md", "# A\n\nabc"), ("b.md", "xyz")], "source_file string, text string")
    path = str(tmp_path / "chunks")
    encode = lambda df: embed_with(df, "content", letter_encoder)
    for _ in range(2):  # a second run replaces the first
        table = build_chunk_table({"one": docs.limit(1), "two": docs}, encode, path)
    assert table.schema == KNOWLEDGE_CHUNKS
    assert sorted((r.domain, r.source_file) for r in table.collect()) == [("one", "a.md"), ("two", "a.md"), ("two", "b.md")]
    assert all(len(r.embedding) == 26 for r in table.collect())


def test_time_grows_with_the_text():
    import time

    text = "\n## Head\n\nsome words in a line\n" * 32_000

    def seconds(n):
        start = time.process_time()
        windows(text[:n], 4000, 600)
        return time.process_time() - start

    seconds(10_000)
    assert min(seconds(1_000_000) for _ in range(3)) < 2.5 * min(seconds(500_000) for _ in range(3))


def test_fixed_chunks_equal_slices(rows):
    rng = random.Random(1)
    texts = ["x" * n for n in (1, 39, 40, 41, 74, 75, 100)]
    texts += ["".join(rng.choices("aé漢😀 \n", k=rng.randrange(1, 400))) for _ in range(30)]
    df = rows(list(enumerate([*texts, "", None])), "id long, text string")
    got = {}
    for r in chunk(df, "text", "id", 40, 6).orderBy("id", "chunk_index").collect():
        got.setdefault(r.id, []).append(r.content)
    for i, text in enumerate(texts):
        want, at = [], 0
        while True:
            want.append(text[at : at + 40])
            if at + 40 >= len(text):
                break
            at += 34
        assert got[i] == want
    assert len(texts) not in got and len(texts) + 1 not in got


def pack(text, size, overlap):
    """The packing rule, written a second time the plain way."""
    import re

    breaks = [r"(?<=\n)(?=#{1,6} )", r"(?=\n\n)", r"(?=\n)", r"(?= )"]

    def pieces(part, level):
        if len(part) <= size:
            return [part]
        if level == len(breaks):
            return [part[i : i + size] for i in range(0, len(part), size)]
        return [q for p in re.split(breaks[level], part) for q in pieces(p, level + 1)]

    chunks, parts = [], []
    for piece in pieces(text, 0):
        if parts and sum(map(len, parts)) + len(piece) > size:
            chunks.append("".join(parts))
            room = min(overlap, size - len(piece))
            while parts and sum(map(len, parts)) > room:
                parts.pop(0)
        parts.append(piece)
    chunks.append("".join(parts))
    return [c.strip() for c in chunks if c.strip()]


def test_heading_chunks(rows):
    rng = random.Random(2)
    words = ["a", "bb", "longer", "\n## H ", "\n\n", "\n", "w" * 30, "é漢"]
    texts = [" ".join(rng.choices(words, k=rng.randrange(1, 120))) for _ in range(60)]
    df = rows(list(enumerate(texts)), "id long, text string")
    got = {}
    out = chunk(df, "text", "id", 60, 15, headings=True).orderBy("id", "chunk_index")
    for r in out.collect():
        got.setdefault(r.id, []).append(r.content)
    for i, text in enumerate(texts):
        assert got.get(i, []) == pack(text, 60, 15)
        assert all(len(c) <= 60 for c in got.get(i, []))


def test_chunk_ids_are_stable(rows):
    df = rows([(1, "abc " * 50)], "id long, text string")
    first = [r.chunk_id for r in chunk(df, "text", "id", 40, 6).collect()]
    again = [r.chunk_id for r in chunk(df.repartition(3), "text", "id", 40, 6).collect()]
    assert sorted(first) == sorted(again) and len(set(first)) == len(first)


def test_directory_source(spark, tmp_path):
    for name in ("one.md", "two copy.md", "Copy.md", "document_template.md", "note.txt"):
        (tmp_path / name).write_text(f"text of {name}\nline")
    got = read_documents(spark, str(tmp_path)).select("source_file", F.col("text")).collect()
    assert [tuple(r) for r in got] == [("one.md", "text of one.md\nline")]
