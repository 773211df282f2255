"""Alignment of two tokenizers against plain Python over whole texts."""

import hashlib
from collections import Counter, defaultdict

import pytest
import sentencepiece
from test_token_store import texts
from tokenizers import Tokenizer

from linkrisk.llm.alignment import align_tokenizers, byte_values, paths
from linkrisk.llm.queries import op11_alignment

DOC = "doc_id long, text string, shard int, n_a string, groups string, id int"


def frame(spark, rows):
    """rows: (doc_id, text); more columns clash with the operator's own names."""
    return spark.createDataFrame([(d, t, 7, "x", "y", 3) for d, t in rows], DOC)


def plain(docs):
    """([(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, sha)], {(b, a): count}) from whole texts, byte by byte."""
    a_path, b_path = paths()
    a, b, value = Tokenizer.from_file(a_path), sentencepiece.SentencePieceProcessor(model_file=b_path), byte_values()
    a.encode_special_tokens = True
    piece = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    counts, made = Counter(), []
    for d, t in docs:
        ids_a = a.encode(" " + t, add_special_tokens=False).ids if t else []
        ids_b = b.encode(t) if t else []
        raw_a = [bytes(value[c] for c in a.id_to_token(i)) if i != 50256 else b"<|endoftext|>" for i in ids_a]
        raw_b = [piece(i) for i in ids_b]
        if not t or not b"".join(raw_a) == b"".join(raw_b) == (" " + t).encode():
            made.append((d, 0, 0, 0, Counter(), ""))
            continue
        own, groups, i, j, end_a, end_b, ga, gb = Counter(), [], 0, 0, len(raw_a[0]), len(raw_b[0]), [ids_a[0]], [ids_b[0]]
        while True:
            own[ids_b[j], ids_a[i]] += 1
            step_a, step_b = end_a <= end_b, end_b <= end_a
            if step_a and step_b:
                groups.append(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)))
                ga, gb = [], []
            if step_a:
                i += 1
            if step_b:
                j += 1
            if i == len(ids_a):
                break
            if step_a:
                ga.append(ids_a[i])
                end_a += len(raw_a[i])
            if step_b:
                gb.append(ids_b[j])
                end_b += len(raw_b[j])
        counts += own
        made.append((d, len(ids_a), len(ids_b), len(groups), own, ";".join(groups)))
    best = defaultdict(int)
    for (y, _), n in counts.items():
        best[y] = max(best[y], n)
    out = []
    for d, na, nb, g, own, text in made:
        hits = sum(n for p, n in own.items() if counts[p] == best[p[0]])
        out.append((d, na, nb, g, sum(own.values()), hits, sum(n * counts[p] for p, n in own.items()), hashlib.sha256(text.encode()).hexdigest() if text else ""))
    return out, counts


def odd():
    more = ["▁", "a▁b", "x ▁ y", "▁▁ lead", " ", "  ", "end ", "end  ", " \n x", "\n  x", "tab\t x", "é  é", "a" * 3000, "日本語 " * 50, "﻿bom", "<s> </s> <unk> <0x41>", "<|endoftext|> x", "same text here", "same text here", " x   y", "̀ ́a"]
    return [*texts()[:60], *texts()[-10:], *more]


@pytest.mark.parametrize("bounds", [{}, {"known": 40, "step": 2000}])  # the second: several shards in a task
def test_alignment_against_plain_python(spark, bounds):
    rows = [*enumerate(odd()), (None, "null id"), (3, "again"), (3, "again")]
    documents, pairs = align_tokenizers(frame(spark, rows).repartition(3), groups=True, **bounds)
    assert documents.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "groups"]
    want, counts = plain(rows)
    got = documents.collect()
    assert sorted((tuple(r)[:8] for r in got), key=str) == sorted(want, key=str)
    assert all((hashlib.sha256(r.groups.encode()).hexdigest() if r.groups else "") == r.groups_sha256 for r in got)
    best = {b: max(n for (y, _), n in counts.items() if y == b) for b, _ in counts}
    assert {(r.b, r.a): (r.n, r.best) for r in pairs.collect()} == {p: (n, n == best[p[0]]) for p, n in counts.items()}


def test_alignment_of_nothing(spark):
    documents, pairs = align_tokenizers(frame(spark, []))
    assert documents.count() == 0 and pairs.count() == 0
    documents, pairs = align_tokenizers(frame(spark, [(1, None), (2, "")]))
    assert {tuple(r) for r in documents.collect()} == {(d, 0, 0, 0, 0, 0, 0, "") for d in (1, 2)} and pairs.count() == 0


def test_op11_keeps_its_contract(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = op11_alignment(spark, sf)
    assert got.dtypes == [*[(c, "bigint") for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")], ("groups_sha256", "string")]
    assert sorted(map(tuple, got.collect())) == sorted(plain(docs)[0])
