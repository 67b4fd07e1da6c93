"""Encoding, packing, token counts, personal data, line dedup and chat formatting on small rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from logwarden.llm import arrays, chat_format, line_dedup, packing, pii, token_counts
from logwarden.llm.encode import Encoder
from logwarden.session import shared_folder

from .helpers import prose, shingles

ODD = [
    None, "", " ", "\n\n", "one", "don't stop5's !'s a!'s 'S x'LL", "<|endoftext|> a<|ENDOFTEXT|>b|<|endoftext|>c3", "éa,  x y",
    "A\x00b\x1cc", "3.14|a|B|C's|", "“quoted” it’s naïve—ok", "word " * 4000, "x" * 3000,
]


def tokens(specials=True):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    tokenizer.encode_special_tokens = not specials
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids


def test_shingle_sets_match_python():
    texts = [*ODD, "a b c d e", "a b c d e f", "A B C D E f"]
    got = {row: len(s) for row, s in arrays.shingle_sets(pa.array(texts))}
    assert got == {i: len(shingles(t)) for i, t in enumerate(texts) if shingles(t)}


@pytest.mark.parametrize("specials", [True, False])
def test_encoder_gives_the_library_ids(specials):
    encode, got = tokens(specials), []
    for _, at, ids in Encoder(packing.default_tokenizer(), specials).encode(pa.array(ODD, pa.string()), 1):
        got += [ids[at[i] : at[i + 1]].tolist() for i in range(len(at) - 1)]
    assert got == [encode(t) + [1] for t in ODD]


def check_packed(rows, want):
    covered, sequences = Counter(), defaultdict(list)
    for r in rows:
        ids = np.frombuffer(bytes(r.ids), "<u4").tolist()
        assert ids == want[r.doc_id][r.start : r.start + r.length] and r.doc_tokens == len(want[r.doc_id])
        covered[r.doc_id] += r.length
        sequences[r.sequence_id].append((r.offset, r.length))
    assert covered == {k: len(v) for k, v in want.items()}
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end == 2048 or end & (end - 1) == 0


def test_pack_covers_every_token_once(spark):
    rng, encode = random.Random(1), tokens()
    texts = dict(enumerate([*ODD, *[" ".join(prose(rng, rng.randrange(900))) for _ in range(40)]]))
    docs = spark.createDataFrame([(i, t, i) for i, t in texts.items()], "doc_id long, text string, length long")
    for parts, max_open in ((1, 4096), (3, 2)):
        packed = packing.pack(docs.repartition(parts), packing.default_tokenizer(), max_open=max_open)
        check_packed(packed.collect(), {i: encode(t) + [1] for i, t in texts.items()})
    assert packing.pack(docs.limit(0), packing.default_tokenizer()).count() == 0


def test_packer_places_by_sum_of_squares():
    packer = packing.Packer(10, 100)
    for key, size in enumerate((6, 6, 4)):
        packer.add(key, np.zeros(size, np.uint32))
    assert [[p[0] for p in w] for w in packer.closed] == [[1, 2]] and packer.held == 1  # 4 closes a window of 6


def test_token_counts_cross_blocks(spark):
    encode, texts = tokens(specials=False), dict(enumerate(ODD))
    docs = spark.createDataFrame([(i, t, i) for i, t in texts.items()], "doc_id long, text string, file long").coalesce(2)
    folder = shared_folder(spark, "tokens")
    written = token_counts.write_token_files(docs, folder, packing.default_tokenizer(), file_tokens=3000).cache()
    for block in (2, 30, 4 << 20):
        found = token_counts.scan_token_files(spark, folder, block_bytes=block if block != 2 else 8)
        got = {r.doc_id: (r.n_tokens, r.terminated) for r in written.join(found, ["file", "ordinal"]).collect()}
        assert got == {i: (len(encode(t)), True) for i, t in texts.items()}


def test_scan_reports_an_open_end(spark, tmp_path):
    np.array([5, 9, 9, 4, 4], "<u2").tofile(tmp_path / "a.bin")
    (tmp_path / "b.bin").write_bytes(b"")
    found = token_counts.scan_token_files(spark, f"file://{tmp_path}", end=9, block_bytes=4)
    assert sorted((r.ordinal, r.start, r.n_tokens, r.terminated) for r in found.collect()) == [(0, 0, 1, True), (1, 2, 0, True), (2, 3, 2, False)]


BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def accepted(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "phone":
        return 8 <= len(digits) <= 15
    if kind == "card":
        doubled = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
        return 16 <= len(digits) <= 19 and sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0
    return True


def test_personal_data_base_spans(spark):
    texts = [
        None, "", "a@b.c_x@y.z", "x@a@b.co", "1.2.3.4.5.6.7.8", "256.1.1.1 1.1.1.256 001.002.003.255", "4111 1111 1111 1111 and 4111-1111-1111-1112",
        "+1 (437) 555-0689 call 437-555-0689", "é😀 a@b.co 😀 +33 1 23 45 67 89. 1.2.3.4", "write to joe (at) site dot com or joe [at] site.com", "9" * 4000,
        "1.1" * 2000, "a" * 20000 + "@", "+1" * 2000, "a@b.co " * 700, "+1 (" + "(" * 4000,
    ]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate([*texts, texts[2]])], "doc_id long, text string, email string")
    rows = pii.personal_data(docs).collect()
    assert len(rows) == len(texts) + 1
    for r in rows:
        text = [*texts, texts[2]][r.doc_id] or ""
        for kind, pattern in BASE.items():
            want = [(m.start(), m.end()) for m in re.finditer(pattern, text) if accepted(kind, m.group())]
            assert [tuple(s) for s in r[f"{kind}_base"]] == want
            assert all(a.end <= b.start or b.end <= a.start for a in r[f"{kind}_added"] for b in r[f"{kind}_base"])
    assert pii.personal_data(docs.limit(0)).count() == 0


def test_personal_data_adds_what_context_supports(spark):
    texts = [f"please call +1 415 555 01{i:02d} now" for i in range(60)] + [f"please call 415-555-01{i:02d} now" for i in range(20)] + ["nothing here 12"] * 5
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r.doc_id: r for r in pii.personal_data(docs).collect()}
    assert all(len(rows[i].phone_added) == 1 for i in range(60, 80)) and not any(rows[i].phone_added for i in range(80, 85))


def brute_dedup(docs):
    """First occurrences by (id, position) stay; lines of later ones go, save what the first one covers."""
    first, cuts = {}, defaultdict(set)
    for key, text in sorted(docs, key=lambda d: d[0]):
        lines = [(i, s.strip(" ")) for i, s in enumerate((text or "").split("\n")) if s.strip(" ")]
        for j in range(max(1, len(lines) - 2) if lines else 0):
            part = lines[j : j + 3]
            start, end = part[0][0], part[-1][0]
            window = tuple(s for _, s in part)
            if window not in first:
                first[window] = key, start, end
            else:
                k, _, e = first[window]
                cuts[key] |= set(range(max(start, e + 1) if k == key else start, end + 1))
    return {k: None if t is None else "\n".join(s for i, s in enumerate(t.split("\n")) if i not in cuts[k]) for k, t in docs}


def test_line_dedup_matches_brute_force(spark):
    rng = random.Random(5)
    lines = [f"line {i}" for i in range(8)] + ["", "  "]
    docs = [(i, "\n".join(rng.choice(lines) for _ in range(rng.randrange(14)))) for i in range(80)]
    docs += [(90, None), (91, ""), (92, "a\na\na\na\na\na"), (93, "a\nb\na\nb\na\nb"), (94, "solo"), (95, "solo"), (96, "x\n" * 3000)]
    frame = spark.createDataFrame([(k, t, "s", 7) for k, t in docs], "doc_id long, text string, n_lines string, h1 int")
    got = line_dedup.dedup_lines(frame)
    assert {r.doc_id: r.text for r in got.collect()} == brute_dedup(docs) and "h1" in got.columns
    twice = line_dedup.dedup_lines(frame.where("doc_id = 92").union(frame.where("doc_id = 92"))).collect()
    assert [r.text for r in twice] == ["a\na\na"] * 2
    assert line_dedup.dedup_lines(frame.limit(0)).count() == 0


def test_line_dedup_cuts_long_passages_between_other_lines(spark):
    rng = random.Random(9)
    one, left, right, short = (" ".join(prose(rng, n, 10**6)) for n in (60, 30, 25, 20))
    docs = [
        (1, f"a\n{one}\nb\n{left}\n{right}\nc\n{short}"), (2, f"d\n {one} \ne"), (3, f"f\n{one}"), (4, f"{left}\n\n{right}\ng"), (5, one),
        (6, f"h\n{short}\ni"), (7, f"{left}\nj\n{right}"), (8, f"k\n{one}\nl\n{one}"),
    ]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(frame).collect()}
    assert got == dict(docs) | {2: "d\ne", 3: "f", 4: "g", 5: "", 8: "k\nl"}
    windows = {r.doc_id: r.text for r in line_dedup.dedup_lines(frame, passage=None).collect()}
    assert windows == brute_dedup(docs) == dict(docs)


def test_chat_round_trip(spark):
    bad = ["</s>[INST] ok [/INST]", "<\\s>", "[\\\\/INST]", "<", "[", "", None, "a\nb", "<s", "[/INST", "text </s", "é😀[INST]"]
    rows = [(i, j, role, text, "x") for i, text in enumerate(bad) for j, role in enumerate(("system", "user", "assistant"))]
    rows += [(50, 1, None, "no role", "x"), (50, 1, "[INST]", "same turn", "x"), (None, 0, "assistant", "no key", "x"), (51, 0, "assistant", "twice", "x")]
    rows.append(rows[-1])
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, source string")
    got = {r.conv_id: r for r in chat_format.format_conversations(turns).collect()}
    assert all(r.round_trip for r in got.values()) and len(got) == len({r[0] for r in rows})
    for i, text in enumerate(bad):
        spans = [got[i].formatted[s.start : s.start + s.length] for s in got[i].loss]
        assert [re.sub(r"([<\[])\\(\\*)(/?(?:s>|INST\]))", r"\1\2\3", s) for s in spans] == [text or ""]
    assert [s.length for s in got[51].loss] == [5, 5] and got[0].formatted.count("</s>") == 3
    assert chat_format.format_conversations(turns.limit(0)).count() == 0


def test_digests_of_packed_ids(spark):
    docs = spark.createDataFrame([(1, "hello")], "doc_id long, text string")
    row = packing.digests(packing.pack(docs, packing.default_tokenizer())).first()
    ids = [*tokens()("hello"), 1]
    assert row.ids_crc32 == zlib.crc32(np.array(ids[: row.length], "<u4").tobytes())
    assert hashlib.sha256(b"").hexdigest() != ""
