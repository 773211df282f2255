"""Packing: every token once, gapless sequences, little padding, odd rows."""

import zlib
from collections import defaultdict

import numpy as np
import pytest
from test_token_store import texts
from tokenizers import Tokenizer

from linkrisk.llm.packing import Classes, pack_documents, packed_pieces
from linkrisk.llm.queries import op12_packing
from linkrisk.llm.token_store import tokenizer_path

DOC = "doc_id long, text string, ids int, docs string, sequence_id long, kind string"


def frame(spark, rows):
    """rows: (doc_id, text); more columns clash with the operator's own names."""
    return spark.createDataFrame([(d, t, 7, "x", 9, "y") for d, t in rows], DOC)


def checked(pieces, docs, capacity=1024, end_id=0):
    """Compares pieces with documents encoded by the tokenizer alone; gives the share of padding."""
    tokenizer = Tokenizer.from_file(tokenizer_path())
    want = defaultdict(list)
    for d, t in docs:
        want[d].append([*tokenizer.encode(t or "", add_special_tokens=False).ids, end_id])
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_sequence[p.sequence_id].append(p)
    assert set(by_doc) == set(want)
    for d, made in want.items():
        # repeated ids: the pieces are those of all rows with the id
        assert sum(p.length for p in by_doc[d]) == sum(map(len, made))
        if len(made) == 1:
            at = 0
            for p in sorted(by_doc[d], key=lambda p: p.start):
                assert p.start == at and p.length > 0 and p.doc_tokens == len(made[0])
                assert p.ids_crc32 == zlib.crc32(np.array(made[0][at : at + p.length], "<u4").tobytes())
                at += p.length
            assert at == len(made[0])
    padding = 0
    for group in by_sequence.values():
        at = 0
        for p in sorted(group, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= capacity
        padding += 0 if at & (at - 1) == 0 else capacity - at
    return padding / sum(p.length for p in pieces)


@pytest.mark.parametrize("capacity", [1, 2, 7, 64, 1000, 1024, 4096])
def test_cuts_fill_classes(capacity):
    classes = Classes(capacity)
    counts = np.arange(1, 3 * capacity + 2)
    row, start, length, kind = classes.cut(counts)
    assert (np.bincount(row, length) == counts).all()
    assert (length <= classes.size[kind]).all() and (classes.size * classes.count <= capacity).all()
    spare = (classes.size[kind] - length) * classes.count[kind]
    assert spare.max() <= 16
    by_row = defaultdict(list)
    for r, s, n in zip(row.tolist(), start.tolist(), length.tolist()):
        by_row[r].append((s, n))
    for spans in by_row.values():
        spans.sort()
        assert [s for s, _ in spans] == [0, *np.cumsum([n for _, n in spans])[:-1].tolist()]
        assert len(spans) <= 3 + 5  # a rest halves, at least, with each piece, and soon by far more


def test_packing_of_odd_rows(spark):
    rows = [(i, t) for i, t in enumerate(texts())] + [(None, "null id"), (3, "again"), (3, "again")]
    docs = frame(spark, rows).repartition(5)
    sequences = pack_documents(docs)
    assert sequences.columns == ["sequence_id", "n_tokens", "ids", "docs", "starts", "lengths", "totals", "offsets"]
    assert checked(packed_pieces(sequences).collect(), rows) < 0.01
    got = sequences.collect()
    assert len({r.sequence_id for r in got}) == len(got) and all(r.n_tokens * 4 == len(r["ids"]) for r in got)
    small = pack_documents(docs, capacity=64, spare=1, end_id=5)
    assert checked(packed_pieces(small).collect(), rows, 64, 5) < 0.05


def test_packing_of_many_tasks(spark):
    """Pieces that tasks leave meet in the sequences of their class."""
    rows = [(i, "word " * (i % 400) + "end") for i in range(3000)]
    got = packed_pieces(pack_documents(frame(spark, rows).repartition(16))).collect()
    assert checked(got, rows) < 0.01
    assert {p.sequence_id >> 62 for p in got} == {0, 1} and len({p.sequence_id >> 48 for p in got if p.sequence_id >> 62}) > 5


def test_packing_of_nothing_and_of_string_ids(spark):
    assert packed_pieces(pack_documents(frame(spark, []))).count() == 0
    got = packed_pieces(pack_documents(spark.createDataFrame([("a", "x"), ("b", None)], "name string, body string"), text="body", id_col="name"), "name").collect()
    assert {(r.name, r.length) for r in got} == {("a", 2), ("b", 1)}


def test_op12_keeps_its_contract(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = op12_packing(spark, sf)
    assert got.dtypes == [("doc_id", "bigint"), ("start", "bigint"), ("length", "bigint"), ("ids_crc32", "bigint"), ("doc_tokens", "bigint"), ("sequence_id", "bigint"), ("offset", "bigint")]
    assert checked(got.collect(), rows) < 0.01
