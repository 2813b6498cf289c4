"""Every piece of every document against the tokenizer, and every sequence against its pieces."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from lexfold.llm import packing
from pyspark.sql import functions as F

from tests.llm import data


def check(rows, docs, capacity):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    want, got, placed = [], [], defaultdict(list)
    for doc_id, text, *_ in docs:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        for k, start in enumerate(range(0, len(ids), capacity)):
            part = ids[start : start + capacity]
            want.append((str(doc_id), k, start, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    for r in rows:
        got.append((str(r["doc_id"]), r["piece"], r["start"], r["length"], r["ids_crc32"]))
        placed[r["sequence_id"]].append((r["offset"], r["length"]))
    assert sorted(got) == sorted(want)
    for parts in placed.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    room: list[int] = []  # of the bins of first fit by falling length
    for n in sorted((w[3] for w in want), reverse=True):
        k = next((k for k, x in enumerate(room) if x >= n), len(room))
        room[k : k + 1] = [(room[k] if k < len(room) else capacity) - n]
    return len(placed), len(room)


@pytest.mark.parametrize("capacity", [7, 64])
def test_pieces_are_those_of_the_tokenizer(spark, capacity):
    r = random.Random(3)
    texts = [" ".join(r.choice(["Lease", "of", "the", "building,", "naïve", "x_1", "§", "İstanbul", "don't"]) for _ in range(r.randint(0, 90))) for _ in range(60)]
    rows = data.rows([*texts, None, "", *texts[:5]]) + [(3, texts[3], "en", "s", 0)] * 40 + [(None, "no id", "en", "s", 0)]
    sequences, simple = check(packing.pack_documents(data.frame(spark, rows), capacity=capacity).collect(), rows, capacity)
    assert sequences <= 1.05 * simple + 1


def test_query_on_its_table(spark, tmp_path):
    df = data.odd(spark).withColumns({"length": F.lit("mine"), "piece": F.lit(9), "_part": F.lit(1)})
    df.write.parquet(str(tmp_path / "documents.parquet"))
    got = packing.op9_packing(spark, str(tmp_path))
    assert got.dtypes == [("doc_id", "bigint"), ("piece", "int"), ("start", "bigint"), ("length", "bigint"), ("ids_crc32", "bigint"), ("sequence_id", "bigint"), ("offset", "bigint")]
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    assert any(r["piece"] > 0 for r in got.collect())
    check(got.collect(), rows, packing.CAPACITY)
