"""Record files: checksums, frames, order, offsets, round trips, damage."""

import glob
import random
import sys
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

sys.path.insert(0, str(Path(__file__).parent))
from corpus_cases import awkward  # noqa: E402

from fonolytics.llm import recordfiles as rf  # noqa: E402
from fonolytics.llm.queries import QUERIES  # noqa: E402

PATH = public_tokenizers.path("byte_bpe_50k.json")
PLAIN = Tokenizer.from_file(PATH)


def ids(text):
    return [*PLAIN.encode(text or "", add_special_tokens=False).ids, 0]


def crc_of(tokens):
    return zlib.crc32(np.array(tokens, "<u4").tobytes())


def direct_crc32c(data):
    crc = 0xFFFFFFFF
    for b in data:
        crc ^= b
        for _ in range(8):
            crc = (crc >> 1) ^ (0x82F63B78 if crc & 1 else 0)
    return crc ^ 0xFFFFFFFF


def test_checksum_of_the_standard_vector():
    data = np.frombuffer(b"123456789", np.uint8)
    assert rf.crc32c(data, np.array([0, 9])).tolist() == [0xE3069283]


@settings(deadline=None, max_examples=60)
@given(st.lists(st.binary(max_size=300), max_size=8), st.integers(1, 200))
def test_checksums_equal_the_bitwise_one(parts, block):
    old, rf.SUM_BYTES = rf.SUM_BYTES, block
    try:
        data, offsets = rf._joined(parts)
        assert rf.crc32c(data, offsets).tolist() == [direct_crc32c(p) for p in parts]
    finally:
        rf.SUM_BYTES = old


def test_checksum_of_long_data():
    data = np.random.default_rng(1).integers(0, 256, 300_000).astype(np.uint8)
    cuts = np.array([0, 1, 64, 64, 4096, 9000, 300_000])
    assert rf.crc32c(data, cuts).tolist() == [direct_crc32c(data[a:b].tobytes()) for a, b in zip(cuts, cuts[1:])]


@pytest.mark.parametrize("width", [2, 4])
def test_frames_round_trip_and_damage_shows(width):
    rng = random.Random(2)
    docs = [[rng.randrange(50000) for _ in range(n)] for n in (0, 1, 5, 700)]
    keys = ["7", None, "", "é"]
    tokens, offsets = np.array(sum(docs, []), np.uint32), np.concatenate(([0], np.cumsum([len(d) for d in docs])))
    made = rf.frames(keys, tokens, offsets, width)
    data, edges = b"".join(made), np.concatenate(([0], np.cumsum([len(m) for m in made])))
    found = rf.parsed(data, edges, "x")
    assert found[0] == keys and [x.tolist() for x in found[1]] == docs
    for spot in (0, 9, 14, len(data) - 1, int(edges[3]) + 20):
        bad = bytearray(data)
        bad[spot] ^= 4
        with pytest.raises(ValueError, match="damaged record"):
            rf.parsed(bytes(bad), edges, "x")


def in_order(docs):
    """(id, tokens) in ascending order of ids; only tests with distinct ids or equal rows may use it."""
    return [(i, ids(t)) for i, t in sorted(docs, key=lambda x: (x[0] is not None, x[0] or 0))]


def test_query_equals_the_contract(spark):
    docs = [(d["doc_id"], d["text"]) for d in pq.read_table("/root/testdata/sf0.001/documents.parquet").to_pylist()]
    got = {r.doc_id: tuple(r)[1:] for r in QUERIES["op11_record_files"](spark, "/root/testdata/sf0.001").collect()}
    start, want = 0, {}
    for i, tokens in in_order(docs):
        want[i] = (start, len(tokens), crc_of(tokens))
        start += len(tokens)
    assert got == want


def test_awkward_rows_in_many_small_files(spark, tmp_path):
    docs = awkward(spark)
    folder = f"{tmp_path}/out"
    files = rf.write_records(docs, folder, PATH, partitions=4, file_bytes=30)
    assert files.count() > 5 and files.agg({"records": "sum"}).first()[0] == docs.count()
    got = sorted(rf.read_records(spark, folder, ids=True).collect(), key=lambda r: r.start)
    want = in_order([(r.doc_id, r.text) for r in docs.collect()])
    assert [(r.doc_id, r.ids) for r in got] == want
    start = 0
    for r in got:
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(r.ids), crc_of(r.ids))
        start += len(r.ids)
    # the files themselves, read in the manifest's order, hold the records one after the other
    names = [r.name for r in files.orderBy("part", "seq").collect()]
    keys = []
    for name in names:
        index = np.fromfile(f"{folder}/files/{name}.idx", "<u8").astype(np.int64).reshape(-1, 2)
        data = Path(f"{folder}/files/{name}.rec").read_bytes()
        assert index[-1, 0] == len(data)
        keys += rf.parsed(data, index[:, 0], name)[0]
    assert keys == [None if i is None else str(i) for i, _ in want]


def test_equal_ids_do_not_make_one_range(spark, tmp_path):
    docs = spark.range(2000).selectExpr("if(id % 3 = 0, 5, id) as doc_id", "if(id % 3 = 0, 'same text', concat('text ', id)) as text")
    files = rf.write_records(docs, f"{tmp_path}/out", PATH, partitions=8).collect()
    assert len(files) == 8 and max(f.records for f in files) < 2000 / 3


def test_shuffled_reads(spark, tmp_path):
    docs = spark.range(300).selectExpr("concat('d', id) as name", "repeat(concat('word', id, ' '), cast(id % 7 as int)) as body", "1 as start")
    folder = f"{tmp_path}/out"
    rf.write_records(docs, folder, PATH, "name", "body", partitions=3, file_bytes=1000)
    read = lambda **k: rf.read_shuffled(spark, folder, doc_id="name", kind="string", partitions=2, **k).collect()
    one, again, other = read(seed=1), read(seed=1), read(seed=1, epoch=1)
    assert one == again and one != other and sorted(one) == sorted(other)
    assert sorted(one) == sorted(rf.read_records(spark, folder, "name", "string", ids=True).collect())
    moved = [int(r.name[1:]) for r in one]
    assert len(set(moved)) == 300 and sum(abs(a - b) > 20 for a, b in zip(moved, moved[1:])) > 150


def test_lost_attempts_leave_no_records(spark, tmp_path):
    folder = f"{tmp_path}/out"
    rf.write_records(spark.range(20).selectExpr("id as doc_id", "'a b' as text"), folder, PATH, partitions=2)
    for f in glob.glob(f"{folder}/files/*.rec"):  # as an attempt that failed after writing would
        Path(f.replace(".rec", "-lost.rec")).write_bytes(b"half a record")
    assert rf.read_records(spark, folder).count() == 20


def test_damaged_file_is_an_error(spark, tmp_path):
    folder = f"{tmp_path}/out"
    rf.write_records(spark.range(20).selectExpr("id as doc_id", "'a b' as text"), folder, PATH, partitions=1)
    (file,) = glob.glob(f"{folder}/files/*.rec")
    data = bytearray(Path(file).read_bytes())
    data[40] ^= 1
    Path(file).write_bytes(data)
    with pytest.raises(Exception, match="damaged record"):
        rf.read_records(spark, folder).collect()


def test_empty_table(spark, tmp_path):
    rf.write_records(awkward(spark, []), f"{tmp_path}/out", PATH)
    assert rf.read_records(spark, f"{tmp_path}/out").collect() == []
    assert rf.read_shuffled(spark, f"{tmp_path}/out").collect() == []
