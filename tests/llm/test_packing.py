import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lectern.llm import packing
from lectern.llm.packing import public_byte_bpe as tokenizer

from .conftest import ODD


def check(rows, texts, width):
    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    assert set(by_doc) == set(range(len(texts)))
    for i, text in enumerate(texts):
        ids = np.array([*own.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids))
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    padding = 0
    for pieces in by_seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= width
        padding += 0 if at & (at - 1) == 0 else width - at
    return padding


@pytest.mark.parametrize("width", [16, 1024])
def test_round_trip(docs, sample, width):
    texts = ODD + ["two  spaces <|endoftext|> here", " \n\n x  y's", "it's 12ab…"] + [r.text for r in sample.limit(80).collect()]
    rows = packing.pack(docs(texts), tokenizer, width=width, space=4).collect()
    assert check(rows, texts, width) == 0


def test_both_encoders_agree(sample):
    quick, own = tokenizer(), packing.byte_bpe(public_tokenizers.path("byte_bpe_50k.json"))
    for text in [*filter(None, ODD), *(r.text for r in sample.limit(60).collect())]:
        assert quick(text).tolist() == own(text).tolist()


def test_windows_are_bounded():
    packer = packing.Packer(8, 2, 0)
    for i, n in enumerate([5, 5, 5, 3, 20, 1, 7, 2]):
        packer.add(i, np.zeros(n, "<u4"))
        assert len(packer.open) <= 2
    packer.finish()
    assert sum(len(p[2]) for p in packer.take()) == 48


def test_empty_table(docs):
    assert packing.pack(docs([]).selectExpr("*", "1 AS start"), tokenizer).count() == 0
