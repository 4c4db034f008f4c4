"""The aligned texts as packed numbers, which Spark passes on as one value each."""

import pyarrow as pa

from vellumflow.llm import token_alignment as ta
from vellumflow.llm.tokens import default_piece_model, default_tokenizer


def test_aligned_texts_are_packed_and_read_as_lists(spark):
    docs = spark.createDataFrame([(1, "the cat sat, 1 + 2"), (2, None), (None, ""), (3, "w" * 3000), (3, "the cat")], "doc_id long, text string")
    paths = default_tokenizer(), default_piece_model()
    packed = ta.packed_texts(docs, *paths)
    assert [t for c, t in packed.dtypes if c in ta.NUMBERS] == ["binary"] * 4
    got, want = (sorted(map(tuple, t.drop("uid").collect()), key=str) for t in (ta.align_texts(docs, *paths), packed))
    assert sorted(([r[0], *(pa.array([v], pa.list_(pa.int32()))[0].as_py() for v in r[1:])] for r in got), key=str) == sorted(([r[0], *(memoryview(bytes(v)).cast("i").tolist() for v in r[1:])] for r in want), key=str)


def test_packed_numbers_of_a_slice_are_those_of_lists():
    rows = [[1, 2, 70_000], [], [5], [6, 7], []]
    lists = pa.array(rows, pa.list_(pa.int32()))
    for kind in (pa.binary(), pa.large_binary()):
        packed = pa.array([b"".join(v.to_bytes(4, "little") for v in r) for r in rows], kind)
        for start, n in ((0, 5), (1, 3), (2, 2), (4, 1), (2, 0)):
            (flat, first), (want, places) = (ta.values(c.slice(start, n)) for c in (packed, lists))
            assert flat.tolist() == want.tolist() and first.tolist() == places.tolist()
