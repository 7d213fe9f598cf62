"""Archives of equal rows, and packing's encoder against the tokenizers library."""

import random

import numpy as np
import public_tokenizers
import pytest

from checkwise.llm import packing, warc


@pytest.mark.parametrize("files", [2, 7])
def test_warc_equal_rows(spark, tmp_path, files):
    """Rows equal in every column, longer than a segment, at the same place of several files; null ids too."""
    g = random.Random(files)
    long = "".join(g.choice("abcdefgh ") for _ in range(60_000))
    rows = [(7, "https://h/x", long), (None, "https://h/y", long), (8, None, "short"), (9, "u", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for i in range(files):
        pages.coalesce(1).write.parquet(str(tmp_path / "pages" / f"part={i}"))
    table = spark.read.parquet(str(tmp_path / "pages")).select("page_id", "url", "html")
    got = warc.archived(table, payloads=True).collect()
    assert len(got) == 4 * files
    digest = warc.base32_sha1(long.encode())
    assert sorted((r.page_id or 0, r.record_type, r.payload_bytes, r.payload_digest == digest) for r in got) == sorted(
        [(7, "response", 60_000, True), (0, "response", 60_000, True), (8, "response", 5, False), (9, "response", 0, False)] * files)
    assert all(bytes(r.payload).decode() == long for r in got if r.payload_bytes == 60_000)


def test_encoder_equals_tokenizers(monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(packing, "PLAIN_CHARS", 2500)
    path = public_tokenizers.path("byte_bpe_50k.json")
    encoder, own = packing.Encoder(path), Tokenizer.from_file(path)
    own.encode_special_tokens = True
    g = random.Random(1)
    plain = "\n\t" + "".join(map(chr, range(32, 127))) + "".join(map(chr, range(0xC0, 0x100)))
    some = ["the ", "  ", "\n\n", " \n", "'s", "don't", "<|endoftext|>", "1234 ", "...", "\t a"]
    other = ["日本語", " ", "\u0085", "\x1c", "\r\n", "𝔘", "ſ", "  ", "é", "́"]
    texts = ["".join(g.choice(plain) for _ in range(g.randrange(0, 200))) for _ in range(500)]
    texts += ["".join(g.choice(some + [c]) for _ in range(40)) for c in plain] + [a + b for a in plain for b in plain[::9]]
    texts += ["".join(g.choice(some + other) for _ in range(40)) for _ in range(200)] + ["a" * 2400, " " * 2400, "a b" * 1000, "a" * 3000, ""]
    for t, ids in zip(texts, encoder.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == own.encode(t, add_special_tokens=False).ids, t[:50]


def test_plan_is_bounded_and_short():
    """Random histograms of many lengths: within the linear program's bound and few seconds, or no longer than largest-first."""
    for m, least in ((177, 3),):
        g = np.random.default_rng(m)
        counts = {int(x): int(g.integers(1, 400)) for x in g.choice(np.arange(least, 2049), m, replace=False)}
        patterns = packing.plan(counts)
        used = {}
        for pattern, times in patterns:
            assert sum(x * k for x, k in pattern.items()) <= 2048
            for x, k in pattern.items():
                used[x] = used.get(x, 0) + k * times
        assert used == counts
        _, bound = packing.solve_lp(counts, 2048, [p for p, _ in packing.fill(counts, 2048)])
        assert packing.sequences(patterns) <= bound * 1.001 + 1
