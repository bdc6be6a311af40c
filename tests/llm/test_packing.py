"""Packing: exact ids against the tokenizer, and every id in exactly one piece."""

import random
import zlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from llm_helpers import docs  # noqa: F401
from windlass.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")
PLAIN = Tokenizer.from_file(PATH)
OURS = packing.Tokens(PATH)


def ids(text):
    return PLAIN.encode(text, add_special_tokens=False).ids


def ours(text):
    return np.frombuffer(OURS.ids(text), "<u4").tolist()


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.characters(max_codepoint=0x250, exclude_categories=["Cs"]), max_size=40))
def test_ids_of_latin_texts(text):
    assert ours(text) == ids(text)


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=30))
def test_ids_of_any_text(text):
    assert ours(text) == ids(text)


ADDED = [t.content for t in PLAIN.get_added_tokens_decoder().values()]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([*ADDED, *map(str.upper, ADDED), "hello", " ", "ü", "<|", "|>", "<", "世"]), max_size=9))
def test_ids_with_added_tokens(parts):
    text = "".join(parts)
    assert ours(text) == ids(text)


def test_added_tokens_are_one_id():
    assert len(ADDED) >= 2
    for t in ADDED:
        assert len(ours(f"hello {t} world")) == 3


def test_ids_of_documents(spark):
    from llm_helpers import SF
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        assert ours(r.text) == ids(r.text)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 9000), max_size=40))
def test_plan_is_a_partition_without_padding(lengths):
    windows = packing.plan(lengths)
    seen = [np.zeros(n, int) for n in lengths]
    for w in windows:
        n = sum(x[2] for x in w)
        assert 0 < n <= 4096 and n & (n - 1) == 0 and all(x[2] > 0 for x in w)
        for doc, start, m in w:
            seen[doc][start:start + m] += 1
    assert all((s == 1).all() for s in seen)
    assert len(windows) - sum(lengths) // 512 <= 12


def test_steps_hold_equal_tokens():
    rng = random.Random(3)
    sizes = [rng.choice([512, 1024, 2048, 4096]) for _ in range(2000)]
    of, tokens = packing.steps(sizes), {}
    for s, n in zip(of, sizes):
        tokens[s] = tokens.get(s, 0) + n
    assert max(tokens.values()) <= 8 * 4096 and min(tokens.values()) >= 6 * 4096


def test_pieces_of_a_table(spark, docs):
    from llm_helpers import SF
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows += [(900001, None), (900002, ""), (900003, "word " * 60_000), (900004, "漢字 and İ mixed")]
    got = packing.pack(docs(rows).repartition(3), group_tokens=50_000).collect()
    want, at, seqs = dict(rows), {}, {}
    for r in got:
        at.setdefault(r.doc_id, []).append(r)
        seqs.setdefault(r.sequence_id, []).append(r)
    assert set(at) == set(want)
    for i, ps in at.items():
        full, pos = np.array([*ids(want[i] or ""), 2], "<u4"), 0
        for p in sorted(ps, key=lambda p: p.start):
            assert (p.start, p.doc_tokens) == (pos, len(full))
            assert p.ids_crc32 == zlib.crc32(full[pos:pos + p.length].tobytes())
            pos += p.length
        assert pos == len(full)
    for ps in seqs.values():
        ps.sort(key=lambda p: p.offset)
        assert [p.offset for p in ps] == [sum(q.length for q in ps[:k]) for k in range(len(ps))]
        n = sum(p.length for p in ps)
        assert n == ps[0].context_size <= 4096 and n & (n - 1) == 0


def test_null_ids_repeated_rows_empty_table(spark):
    d = spark.createDataFrame([(None, "a b", 1), (4, "c", 2), (4, "c", 2)], "doc_id long, text string, start int")
    got = packing.pack(d).collect()
    assert sorted((r.doc_tokens for r in got if r.doc_id == 4), key=str) and \
        sum(r.length for r in got) == 3 + 2 + 2
    assert packing.pack(d.limit(0)).count() == 0
