"""Token files as wide as the vocabulary asks."""

from tokenizers import Tokenizer
from tokenizers.models import WordLevel

from logwarden.llm import packing, token_counts
from logwarden.session import shared_folder


def test_width_follows_the_vocabulary(tmp_path):
    for n, width in ((1 << 16, 2), (70_000, 4)):
        Tokenizer(WordLevel({f"w{i}": i for i in range(n)}, unk_token="w0")).save(str(tmp_path / "t.json"))
        assert token_counts.token_width(str(tmp_path / "t.json")) == width
    assert token_counts.token_width(packing.default_tokenizer()) == 2


def test_wide_files_and_odd_rows(spark):
    rows = [(None, "one two", 1), (4, None, 2), (4, "", 3), (5, "three", 4), (5, "three", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens long")
    got = {}
    for width in (2, 4):
        folder = shared_folder(spark, "wide")
        written = token_counts.write_token_files(docs, folder, packing.default_tokenizer(), width=width)
        counted = written.join(token_counts.scan_token_files(spark, folder, width=width, block_bytes=8), ["file", "ordinal"])
        got[width] = sorted(((r.doc_id, r.n_tokens) for r in counted.collect()), key=repr)
    assert got[2] == got[4] and [k for k, _ in got[2]].count(None) == 1 and len(got[2]) == 5
    assert sorted(n for k, n in got[2] if k == 4) == [0, 0]
    none = shared_folder(spark, "none")
    assert token_counts.write_token_files(docs.limit(0), none, packing.default_tokenizer()).count() == 0
