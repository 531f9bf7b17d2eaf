import random
import sys
import zlib
from collections import defaultdict
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

sys.path.insert(0, str(Path(__file__).parent))
from corpus_cases import awkward  # noqa: E402

from fonolytics.llm.packing import pack, pack_documents, place, token_pieces  # noqa: E402
from fonolytics.llm.tokens import PieceEncoder  # noqa: E402

PATH = public_tokenizers.path("byte_bpe_50k.json")
PLAIN = Tokenizer.from_file(PATH)


def ids(text):
    return [*PLAIN.encode(text or "", add_special_tokens=False).ids, 0]


@settings(derandomize=True, deadline=None, max_examples=300)
@given(st.lists(st.lists(st.sampled_from([*"abst'’ re ll\n\t  .!09½é漢😀́　\x1c\x85", "'ve", "'d", "  ", "<|endoftext|>", "<|", "text|>"]), max_size=12).map("".join), max_size=6))
def test_ids_equal_the_tokenizer(texts):
    out, offsets = PieceEncoder.of(PATH).encode(pa.array(texts, pa.string()), 0)
    for i, t in enumerate(texts):
        assert out[offsets[i] : offsets[i + 1]].tolist() == ids(t)


def test_forgetting_pieces_changes_nothing(monkeypatch):
    monkeypatch.setattr("fonolytics.llm.tokens.KEEP", 3)
    e = PieceEncoder(PATH)
    for text in ("one two three four", "two five six one", "one"):
        assert e.encode(pa.array([text]), 0)[0].tolist() == ids(text)


def check_places(rows, capacity):
    by_sequence = defaultdict(list)
    for r in rows:
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for spans in by_sequence.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by_sequence)


@pytest.mark.parametrize("capacity", [16, 2048])
def test_pieces_and_places(spark, capacity):
    docs = awkward(spark).where("doc_id <> 6")
    rows = pack_documents(docs, PATH, capacity).collect()
    check_places(rows, capacity)
    texts = {r.doc_id: r.text for r in docs.collect()}
    pieces = defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
    assert set(pieces) == set(texts)
    for i, own in pieces.items():
        want, own = ids(texts[i]), sorted(own, key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own))) and all(r.length == capacity for r in own[1:])
        at = 0
        for r in own:
            part = np.array(want[at : at + r.length], "<u4")
            assert (r.start, r.ids_crc32) == (at, zlib.crc32(part.tobytes()))
            at += r.length
        assert at == len(want)


def test_ids_of_pieces(spark):
    rows = token_pieces(awkward(spark).where("doc_id = 7 or doc_id = 2"), PATH, 4, ids=True).orderBy("doc_id", "piece").collect()
    assert sum((r.ids for r in rows if r.doc_id == 7), []) == ids("été ÉTÉ 漢字 😀 <|endoftext|> it's")
    assert [r.ids for r in rows if r.doc_id == 2] == [[0]]


def test_each_choice_has_the_smallest_sum_of_squares():
    rng = random.Random(1)
    lengths, capacity = np.array([rng.randrange(1, 30) for _ in range(300)]), 30
    sequence, offset = place(lengths, capacity)
    gaps = {}
    for i in np.argsort(-lengths, kind="stable"):
        s, count = lengths[i], defaultdict(int)
        for g in gaps.values():
            count[g] += 1
        room = {g for g in gaps.values() if g >= s}

        def total(g):
            c = dict(count)
            c[g] -= 1
            if g > s:
                c[g - s] = c.get(g - s, 0) + 1
            return sum(n * n for n in c.values())

        if room:
            g = gaps[sequence[i]]
            assert total(g) == min(map(total, room)) and offset[i] == capacity - g
        else:
            assert sequence[i] not in gaps and offset[i] == 0
            g = capacity
        gaps[sequence[i]] = g - s
        if not gaps[sequence[i]]:
            del gaps[sequence[i]]


def test_groups_leave_little_room(spark):
    rng = random.Random(2)
    sizes = [rng.randrange(1, 2049) for _ in range(4000)]
    rows = pack(spark.createDataFrame([(i, n) for i, n in enumerate(sizes)], "doc_id long, length long"), 2048, group=1000).collect()
    assert len(rows) == 4000 and sorted(r.length for r in rows) == sorted(sizes)
    assert check_places(rows, 2048) <= 1.03 * sum(sizes) / 2048
    with pytest.raises(ValueError):
        token_pieces(awkward(spark), PATH, 0)
