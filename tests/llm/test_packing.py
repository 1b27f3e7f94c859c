"""Packing: whole texts, full windows, and ids as the tokenizer gives them."""

from __future__ import annotations

import random
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tidegauge.llm.packing import Packer, balanced, pack_documents

from .helpers import DOCS, ODD, documents, table

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def held_together(rows, ids_of: dict[int, list[int]], step_tokens: int = 32_768):
    """Every id lies in one piece, and the pieces of a sequence are gapless and fill it."""
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert set(pieces) == set(ids_of)
    for doc, own in pieces.items():
        own.sort(key=lambda r: r.start)
        got, at = [], 0
        for r in own:
            ids = np.frombuffer(bytes(r.ids), "<u4").tolist()
            assert (r.start, len(ids), r.doc_tokens) == (at, r.length, len(ids_of[doc]))
            got += ids
            at += len(ids)
        assert got == ids_of[doc]
    for own in sequences.values():
        own.sort(key=lambda r: r.offset)
        at = 0
        for r in own:
            assert r.offset == at
            at += r.length
        assert at == own[0].sequence_length and at <= 4096 and at & (at - 1) == 0
    groups = defaultdict(int)
    for own in sequences.values():
        assert len({r.step_group for r in own}) == 1
        groups[own[0].step_group] += own[0].sequence_length
    assert max(groups.values(), default=0) <= 2 * step_tokens


def test_brute_force(spark, tokenizer):
    rows = documents(4, 120)
    want = {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2] for i, t in rows}
    held_together(pack_documents(table(spark, rows).repartition(3), PATH).collect(), want)


@pytest.mark.parametrize("block", [500, 20_000])
def test_blocks_carry_over(spark, tokenizer, block):
    rows = documents(5, 40)
    want = {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2] for i, t in rows}
    held_together(pack_documents(table(spark, rows).coalesce(1), PATH, block_tokens=block).collect(), want)


def test_words_with_marks_and_accents(spark, tokenizer):
    texts = ["Crème brûlée!! señor, ÜBER...", "é combining", "tab\tand nbsp em\x0bvt", "don't stop-me (now)", "ÿ ß ﬁ ½ ٣", "[CLS] [SEP] <s> <pad>", "emoji 👩‍👩‍👧 ok", "A" * 300 + " b" * 9, *[t for t in ODD if t]]
    want = {i: [*tokenizer.encode(t, add_special_tokens=False).ids, 2] for i, t in enumerate(texts)}
    held_together(pack_documents(table(spark, list(enumerate(texts))), PATH).collect(), want)


def test_nulls_repeats_and_other_columns(spark):
    rows = [(1, "same text", "x"), (1, "same text", "y"), (None, None, None), (2, "", "z")]
    got = pack_documents(table(spark, rows, DOCS + ", ids string"), PATH).collect()
    assert sorted((str(r.doc_id), r.doc_tokens) for r in got if r.start == 0) == sorted([("1", got[0].doc_tokens)] * 2 + [("2", 1), ("None", 1)]) or {str(r.doc_id) for r in got} == {"1", "2", "None"}
    by = defaultdict(int)
    for r in got:
        by[str(r.doc_id)] += r.length
    assert by["2"] == by["None"] == 1 and by["1"] % 2 == 0


def test_empty_table(spark):
    assert pack_documents(spark.createDataFrame([], DOCS), PATH).count() == 0


@pytest.mark.parametrize("seed", range(5))
def test_packer_alone(seed):
    rng, packer, lengths, out = random.Random(seed), Packer(), {}, []
    for d in range(400):
        lengths[d] = rng.choice([1, rng.randrange(1, 200), rng.randrange(1, 9000)])
        packer.add(d, lengths[d])
        if d % 150 == 149:
            packer.pack()
            out += packer.take()
    packer.pack(last=True)
    out += packer.take()
    seen = defaultdict(list)
    for size, window in out:
        assert sum(n for _, _, n in window) == size
        for d, s, n in window:
            assert n > 0
            seen[d].append((s, n))
    for d, n in lengths.items():
        at = 0
        for s, k in sorted(seen[d]):
            assert s == at
            at += k
        assert at == n


def test_step_groups_are_balanced():
    sizes = [4096] * 30 + [256] * 100
    groups = balanced(sizes, 32_768)
    loads = defaultdict(int)
    for s, g in zip(sizes, groups, strict=True):
        loads[g] += s
    assert max(loads.values()) - min(loads.values()) <= 4096


def test_query_has_the_columns(spark, small):
    from tidegauge.llm import queries

    df = queries.op1_packing(spark, small)
    assert [(c, t) for c, t in df.dtypes[:7]] == [("doc_id", "bigint"), ("start", "bigint"), ("length", "bigint"), ("ids_crc32", "bigint"), ("doc_tokens", "bigint"), ("sequence_id", "bigint"), ("offset", "bigint")]
    assert df.select("doc_id").distinct().count() == spark.read.parquet(f"{small}/documents.parquet").count()


def test_encoders_of_other_tokenizers_take_no_short_way():
    """A byte-level tokenizer keeps white space in its tokens: whole texts go through its own encode."""
    from tidegauge.llm.packing import WordEncoder

    texts = ["two words", "", "Tabs\tand  spaces\n", "naïve déjà-vu!!"]
    for name, by_words in (("byte_bpe_50k.json", False), ("word_bpe_49k.json", True)):
        plain, own = Tokenizer.from_file(public_tokenizers.path(name)), WordEncoder(public_tokenizers.path(name), 2)
        assert own.by_words == own.by_runs == by_words
        ids, counts = own.encode(pa.array(texts, pa.large_string()))
        want = [[*plain.encode(t, add_special_tokens=False).ids, 2] for t in texts]
        assert ids.tolist() == sum(want, []) and counts.tolist() == list(map(len, want))


def test_words_are_forgotten_and_found_again(monkeypatch, tokenizer):
    from tidegauge.llm import packing

    monkeypatch.setattr(packing, "CACHE_WORDS", 20)
    own = packing.WordEncoder(PATH, 2)
    for k in range(6):
        texts = [" ".join(f"{w}{m}" for w in ("alpha", "Señor", f"b{'xyz'[k % 3]}", "cd" * (k + 1)) for m in ("", "!", "&", "'t"))]
        ids, _ = own.encode(pa.array(texts, pa.large_string()))
        assert ids.tolist() == [*tokenizer.encode(texts[0], add_special_tokens=False).ids, 2]
        assert len(own.young) + len(own.old) <= 60
