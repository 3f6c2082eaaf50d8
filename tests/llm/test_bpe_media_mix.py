import hashlib
import struct
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from fathomline.llm import bpe, matroska, mixing, token_counts
from fathomline.llm.registry import vocabulary_path
from tests.llm.helpers import ODD, docs

PATH = vocabulary_path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("abcdefghijklmnopqrstuvwxyzABC 0123456789'.,!\n\tßéñ日本😀<|>")), max_size=60))
def test_bpe_equals_library(library, text):
    v = bpe.vocabulary(PATH)
    text += "<|endoftext|>" * (len(text) % 5 == 0) + text[:7]
    ids = np.frombuffer(v.encode([text], {})[0], "<u4").tolist()
    assert ids == library.encode(text, add_special_tokens=False).ids
    assert v.decode(np.array(ids, "<u4").tobytes()) == library.decode(ids, skip_special_tokens=False)


def test_long_words_merge_alike():
    v = bpe.vocabulary(PATH)
    for w in (b"a" * 3000, b"abcabcx" * 300):
        short, bpe.SHORT = bpe.SHORT, len(w)
        scanned = v.merge(w)
        bpe.SHORT = short
        assert v.merge(w) == scanned


def test_pairs_stand_as_exact_merging_says():
    v, rng = bpe.vocabulary(PATH), np.random.default_rng(0)
    a, b = rng.integers(0, 50_000, 400), rng.integers(0, 50_000, 400)
    own = [v.stands(int(x)) and v.stands(int(y)) for x, y in zip(a, b, strict=True)]
    for x, y, fine, ok in zip(a, b, v.pairs_stand(a, b), own, strict=True):
        if ok:
            assert fine == (v.merge(v.bytes_of[x] + v.bytes_of[y]) == [x, y])


def test_bpe_table(spark, library):
    got = Counter(map(tuple, bpe.digests(docs(spark, ODD), PATH).collect()))
    want = Counter()
    for i, t, *_ in ODD:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want[i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()] += 1
    assert got == want
    assert bpe.digests(docs(spark, []), PATH).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=9000), st.sampled_from([64, 512, 700]), st.integers(1, 9), st.sampled_from([None, 0, 1, 2, 3]))
def test_matroska_round_trip(raw, frame, laced, lacing):
    payload = matroska.pad(raw)
    media = matroska.write(payload, frame, 1 if lacing == 0 else laced, lacing)
    packets, cues, facts = matroska.parse(media)
    assert facts["fault"] is None and facts["bits"] == 8
    assert matroska.samples(media, packets) == payload
    assert [p[2] for p in packets] == [k * (frame * 1000 // matroska.RATE) * matroska.MS for k in range(len(packets))]
    for _, _, at in cues:
        assert media[at : at + 4] == b"\x1f\x43\xb6\x75"


def test_matroska_unknown_sizes_and_cuts():
    media = matroska.write(matroska.pad(b"hello" * 900))
    packets, *_ = matroska.parse(media)
    at = media.index(b"\x18\x53\x80\x67") + 4
    _, end, _ = matroska.vint(media, at)
    endless = media[:at] + b"\x01" + b"\xff" * 7 + media[end:]
    assert matroska.samples(endless, matroska.parse(endless)[0]) == matroska.pad(b"hello" * 900)
    for cut in range(0, len(media), 97):
        found, _, facts = matroska.parse(media[:cut])
        assert [p[:3] for p in found] == [p[:3] for p in packets][: len(found)]
    assert matroska.parse(b"no such format")[0] == []


def test_media_table(spark):
    rows = {(r.doc_id, r.n_bytes): r for r in matroska.digests(docs(spark, ODD)).collect()}
    for i, t, *_ in ODD:
        raw = (t or "").encode()
        payload = raw + b"\0" * (-len(raw) % 64 or (0 if raw else 64))
        r = rows[i, len(raw)]
        assert (r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert r.media_bytes == len(matroska.write(payload)) and r.media_sha256 == hashlib.sha256(matroska.write(payload)).hexdigest()
    assert rows[1, len(ODD[0][1])].feature == rows[5, len(ODD[0][1])].feature
    packed = matroska.pack(docs(spark, ODD))
    table = matroska.packet_table(packed).groupBy("doc_id").sum("size").collect()
    assert {r[0]: r[1] for r in table if r[0] in (1, 7)} == {i: len(matroska.pad(t.encode())) for i, t, *_ in ODD if i in (1, 7)}
    assert matroska.cue_table(packed).filter("doc_id = 7").count() >= 1
    assert matroska.packet_table(spark.createDataFrame([(1, None), (2, bytearray(b"junk"))], "doc_id long, media binary")).count() == 0


def test_lace_of_ebml_sizes():
    frames = [b"x" * n for n in (800, 500, 1000, 10)]
    head = matroska.lace(frames, matroska.EBML_LACING)
    block = head + b"".join(frames)
    sizes, at = matroska.lace_sizes(block, 0, len(block), matroska.EBML_LACING)
    assert sizes == [800, 500, 1000, 10] and at == len(head)
    assert struct.unpack("B", head[:1]) == (3,)


def test_token_counts(spark):
    path = vocabulary_path("byte_bpe_50k.tiktoken")
    hist = token_counts.histogram(docs(spark, ODD), path)
    lengths = sorted(len(token_counts.encoder(path).encode_ordinary(t or "")) for _, t, *_ in ODD)
    assert sorted(n for r in hist.collect() for n in [r.n_tokens] * r.n_docs) == lengths
    for r in token_counts.suffix_sums(hist).collect():
        n = r.n_tokens
        assert r.docs_at_least == sum(x >= n for x in lengths) and r.tokens_at_least == sum(x for x in lengths if x >= n)
        assert r.truncated_tokens == sum(min(x, n) for x in lengths) and r.share_at_most == sum(x <= n for x in lengths) / len(lengths)
    for r in token_counts.at_limits(hist, [0, 50, 10**6]).collect():
        assert r.truncated_tokens == sum(min(x, r.context_limit) for x in lengths) and r.whole_docs == sum(x <= r.context_limit for x in lengths)
    q = {r.share: r.n_tokens for r in token_counts.quantiles(hist, [0.5, 1.0]).collect()}
    assert q[1.0] == max(lengths) and q[0.5] == lengths[(len(lengths) + 1) // 2 - 1]
    assert token_counts.report(docs(spark, []), path).count() == 0


def test_mixing_targets_and_budgets(spark):
    rows = [(k, " ".join(["w"] * (k % 23 + 1)), "en", s) for k, s in enumerate(["a"] * 400 + ["b"] * 60 + ["c"] * 10 + [None] * 30)] + [(900, None, "en", "a"), (901, "", "en", "z")]
    got = mixing.plan(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    source = {i: s for i, _, _, s in rows}
    total = sum(r.size for r in got)
    by: dict = {}
    for r in got:
        assert 0 <= r.taken <= 3 * r.size and r.taken % max(1, r.size) == 0
        s = by.setdefault(source[r.doc_id], [r.source_size, r.target, 0])
        s[2] += r.taken
    assert abs(sum(t for _, t, _ in by.values()) - total) < 1e-6
    for size, target, taken in by.values():
        assert target <= 3 * size + 1e-9 and abs(taken - target) <= 23
    assert by["c"][1] == 3 * by["c"][0]  # a small source is capped
    again = mixing.plan(docs(spark, rows).repartition(7)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))
    mixed = mixing.mix(docs(spark, rows))
    assert mixed.columns == docs(spark, []).columns
    counts = Counter(r.doc_id for r in mixed.select("doc_id").collect())
    assert all(counts[r.doc_id] == (r.taken // r.size if r.size else 1) for r in got)
    assert mixing.plan(docs(spark, [])).count() == 0 and mixing.plan(docs(spark, ODD)).count() == len(ODD)


def test_mixing_prefers_better_documents(spark):
    rows = [(k, ("%%% *** $$$ &&& " if k % 2 else "good plain words here ") * 5, "en", "s") for k in range(600)] + [(1000 + k, "word " * 20, "en", "t") for k in range(900)]
    taken = {r.doc_id: r.taken for r in mixing.plan(docs(spark, rows)).collect()}
    good, bad = sum(taken[k] > 0 for k in range(0, 600, 2)), sum(taken[k] > 0 for k in range(1, 600, 2))
    assert good - bad >= 90
