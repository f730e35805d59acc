import resource

import pyarrow as pa
import zstandard

from panelkiln.llm import near_dedup, substring_dedup
from panelkiln.llm.textops import packed_pieces

LINE = "the same line of a text that repeats itself\n"


def packed(text):
    return zstandard.compress(text.encode(), 1)


def test_slices_hold_unpacked_bytes():
    texts = ["", "a" * 900, LINE * 50, None, "b" * 5_000, "c", "d" * 700]
    batch = pa.RecordBatch.from_arrays([pa.array(range(7)), pa.array([None if t is None else packed(t) for t in texts], pa.binary())], ["id", "text"])
    found = [p.column(0).to_pylist() for p in packed_pieces(batch, ["text"], 1_000)]
    assert [k for p in found for k in p] == list(range(7)) and found == [[0, 1], [2], [3], [4], [5, 6]]
    assert list(packed_pieces(batch.slice(0, 0), ["text"])) == []


def grown(run, batch):
    """Rows, and MB that this process grew by."""
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    rows = sum(b.num_rows for b in run(iter([batch])))
    return rows, (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) / 1024


def test_pairs_of_texts_of_one_line_take_little_memory():
    text = packed(LINE * 4_600)  # 200 KB
    other = packed(LINE * 4_599 + "another end")
    batch = pa.RecordBatch.from_arrays([pa.array([1] * 600), pa.array(range(600)), pa.array([text] * 600, pa.binary()), pa.array([other] * 600, pa.binary())], ["a", "b", "text_a", "text_b"])
    rows, mb = grown(near_dedup._verify_batches(5, 80), batch)
    assert rows == 600 and mb < 400


def test_cutting_long_texts_of_one_line_takes_little_memory():
    text = packed(LINE * 23_000)  # 1 MB
    batch = pa.RecordBatch.from_arrays([pa.array([text] * 300, pa.binary()), pa.array([[5]] * 300, pa.list_(pa.int64())), pa.array(range(300))], ["__text", "__cuts", "__0"])
    rows, mb = grown(substring_dedup._cut_batches, batch)
    assert rows == 300 and mb < 300


def test_texts_too_many_for_a_filter_give_the_same_cuts(spark, monkeypatch):
    passage = " ".join(f"word{k}" for k in range(60))
    rows = [(k, f"Begin {k} here and {k}. {passage}. End {k} {k}.") for k in range(6)] + [(9, None), (10, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(map(repr, substring_dedup.remove_repeated(docs).collect()))
    monkeypatch.setattr(substring_dedup, "MOST_FILTERED", -1)
    assert sorted(map(repr, substring_dedup.remove_repeated(docs).collect())) == want and "word30" not in want[3]
