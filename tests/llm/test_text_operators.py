"""Operators on documents against brute force."""

from collections import Counter, defaultdict

import brute
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from checkwise.llm import bpe, linededup, minhash, packing, pii, quality, queries, substring

JSON = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def key(x):
    return tuple((v is not None, v) for v in x)


def same(rows, expected):
    assert sorted(map(tuple, rows), key=key) == sorted(map(tuple, expected), key=key)


def test_pii_base_spans(docs, plain):
    rows = pii.find(docs.select("doc_id", "text")).select("text", "spans").collect()
    for r in rows:
        base = [(s.kind, s.start, s.end) for s in r.spans if s.kind in pii.BASE]
        assert base == brute.pii_base(r.text), r.text
    assert Counter(s.kind for r in rows for s in r.spans)["iban"] == 1
    assert Counter(s.kind for r in rows for s in r.spans)["ssn"] == 1


def test_pii_redact(docs):
    done = {r.doc_id: r.text for r in pii.redact(docs).filter("doc_id >= 900").collect()}
    assert done[918] == "mail <EMAIL><EMAIL>, <EMAIL> IBAN <IBAN> ssn <SSN> <PHONE>-"
    assert done[919].startswith("<CARD> and 4111-1111-1111-1112 10.0.0.256 <IP>.<IP> <IP> é<PHONE>")
    assert done[900] is None and done[901] == ""


def test_pii_checksums(spark):
    rows = spark.sql("select * from values ('GB82 WEST 1234 5698 7654 32'), ('GB82 WEST 1234 5698 7654 33') t(x)")
    assert [r[0] for r in rows.select(pii.mod97(F.col("x"))).collect()] == [True, False]


def test_line_dedup(docs, plain):
    rows = linededup.dedup_lines(docs.select("doc_id", "text")).select(
        "doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256)).collect()
    same(rows, brute.line_dedup(plain))
    assert sum(r.n_dropped for r in rows) >= 6


def test_substring_dedup(docs, plain):
    rows = substring.digest(docs).collect()
    same(rows, brute.substring_dedup(plain))
    assert sum(r.n_removed for r in rows) > 1000
    texts = {r.doc_id: r.kept_text for r in substring.cleaned(docs).filter("doc_id >= 900").collect()}
    assert texts[907] == "" and texts[913].endswith("y z")


def test_quality_base(docs, plain):
    rows = quality.judge(docs).collect()
    same([(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
          for r in rows], [(i, *brute.quality_base(t)) for i, t in plain])


def test_quality_verdict(spark):
    import random
    g = random.Random(5)
    texts = [" ".join(g.choice("ab") for _ in range(g.randint(0, 40))) for _ in range(150)]
    texts += [" ".join(f"u{i}" for i in range(100)), " ".join(f"u{i % 30}" for i in range(100))]
    rows = quality.judge(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), min_repeat=4).collect()
    for r in rows:
        w = texts[r.doc_id].split()
        longest = brute.longest_repeats(w)
        covered = {j for i, n in enumerate(longest) if n >= 4 for j in range(i, i + n)}
        assert (r.longest_repeat, r.covered_words) == (max(longest, default=0), len(covered))
        assert r.kept == (not r.base_failed and len(covered) <= 0.5 * len(w))


def test_quality_limits_act_beyond_base(spark):
    words = lambda tag, n: " ".join(f"{tag}{i}" for i in range(n))
    pasted = words("p", 90)
    line = words("l", 13)
    refrain = words("r", 12)
    texts = {
        "clean": words("a", 400),
        "line twice": f"{line} {words('a', 100)} {line}",
        "50 words twice": f"{words('p', 50)} {words('a', 400)} {words('p', 50)}",
        "covered": f"{pasted} {words('a', 110)} {pasted} {words('b', 110)}",
        "covered by short repeats": " ".join(f"{words(f'b{i}x', 24)} {refrain}" for i in range(10)),
        "longest": f"{words('a', 500)} {words('p', 51)} {words('b', 500)} {words('p', 51)}",
    }
    df = spark.createDataFrame(list(texts.items()), "doc_id string, text string")
    rows = {r.doc_id: r for r in quality.judge(df).collect()}
    assert not any(r.base_failed for r in rows.values())
    assert {i for i, r in rows.items() if r.kept} == {"clean", "line twice", "50 words twice"}
    assert (rows["covered"].n_words, rows["covered"].covered_words) == (400, 180)
    short, long = rows["covered by short repeats"], rows["longest"]
    assert short.longest_repeat <= 50 and short.covered_words > 0.3 * short.n_words
    assert long.longest_repeat == 51 and long.covered_words < 0.3 * long.n_words
    assert {r.doc_id for r in quality.keep_good(df).collect()} == {"clean", "line twice", "50 words twice"}


def test_quality_keeps_columns(docs):
    kept = quality.keep_good(docs)
    assert kept.schema == docs.schema
    verdict = quality.judge(docs).filter("kept").count()
    assert kept.count() == verdict > 100


def test_near_classes(docs, plain):
    rows = minhash.classes(docs).collect()
    assert len(rows) == len({i for i, _ in plain})
    found = {r.doc_id: r.class_id for r in rows if r.doc_id is not None}
    expected, _ = brute.near_classes(sorted({i: t for i, t in plain if i is not None}.items()))
    assert found == expected
    assert found[908] == 906 and found[904] == 903 and found[901] == 901


def test_near_dedup_keeps_one(docs):
    kept = minhash.drop_near(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.select("doc_id").collect()]
    assert 906 in ids and 907 not in ids and 908 not in ids and None in ids


def test_sampler_estimates_similarity():
    import numpy as np
    h = np.arange(1, 401, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    w = np.linspace(1, 3, 400)
    s = minhash.Sampler(512)
    a = s.draw(np.zeros(320, int), h[:320], w[:320], 1)
    b = s.draw(np.zeros(320, int), h[80:], w[80:], 1)
    true = w[80:320].sum() / w.sum()
    assert abs((a == b).mean() - true) < 0.08


def test_bpe_round_trip(docs, plain):
    import numpy as np
    import tiktoken
    known = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(RANKS),
                              special_tokens={})
    want = Counter()
    for i, t in plain:
        ids = known.encode_ordinary(t or "")
        want[(i, len(ids), brute.sha(np.array(ids, "<u4").tobytes()), brute.sha(t or ""))] += 1
    assert Counter(map(tuple, bpe.digest(docs, RANKS, public_tokenizers.PATTERN).collect())) == want
    full = bpe.encode(docs, RANKS, public_tokenizers.PATTERN).filter("doc_id = 920").first()
    assert bytes(full.decoded).decode() == dict(plain)[920] and full.ids == known.encode_ordinary(dict(plain)[920])


def test_replay_odd_words():
    """Vocabularies in which a merge opens a pair of lower rank."""
    import random
    import tiktoken
    g = random.Random(11)
    for _ in range(20):
        ranks = {bytes((c,)): c for c in range(256)}
        while len(ranks) < 256 + 40:
            x = bytes(g.choice(b"abc") for _ in range(g.randint(2, 5)))
            if x not in ranks and any(x[:i] in ranks and x[i:] in ranks for i in range(1, len(x))):
                ranks[x] = len(ranks)
        items = list(ranks.items())[256:]
        order = [r for _, r in items]
        g.shuffle(order)
        ranks = {bytes((c,)): c for c in range(256)} | {t: r for (t, _), r in zip(items, order, strict=True)}
        enc = tiktoken.Encoding("own", pat_str=r"[abc]+", mergeable_ranks=ranks, special_tokens={})
        words = [bytes(g.choice(b"abc") for _ in range(g.randint(1, 30))) for _ in range(200)]
        ids, counts = bpe.Replay(ranks).solve(words)
        at = 0
        for w, n in zip(words, counts.tolist(), strict=True):
            assert ids[at:at + n].tolist() == enc.encode_ordinary(w.decode()), w
            at += n


def check_packing(rows, plain, size):
    from tokenizers import Tokenizer
    tk = Tokenizer.from_file(JSON)
    tk.encode_special_tokens = True
    want = Counter()
    for i, t in plain:
        ids = tk.encode(t or "", add_special_tokens=False).ids + [0]
        cuts = [0, *range(len(ids) % size or size, len(ids) + 1, size)] if len(ids) > size else [0, len(ids)]
        for p in range(len(cuts) - 1):
            want[(i, p, cuts[p], cuts[p + 1] - cuts[p], brute.crc(ids[cuts[p]:cuts[p + 1]]))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= size
    return len(sequences), -(-sum(r.length for r in rows) // size)


@pytest.mark.parametrize("size", [2048, 64])
def test_packing(docs, plain, size):
    n, bound = check_packing(packing.pack(docs, JSON, size=size).collect(), plain, size)
    assert bound <= n <= bound * 1.02 + 1


def test_packing_plan_beats_plain_filling():
    counts = {7: 30, 5: 40, 3: 11, 2: 50, 1: 3}
    done = packing.plan(counts, 10)
    assert Counter({x: sum(p.get(x, 0) * t for p, t in done) for x in counts}) == counts
    assert all(sum(x * k for x, k in p.items()) <= 10 for p, _ in done)
    assert packing.best_filling(__import__("numpy").array([6, 5, 4]), __import__("numpy").array([7.0, 5.0, 4.0]), 10) == {6: 1, 4: 1}


def test_packing_plan_finds_planted_patterns():
    import random
    g = random.Random(1)
    counts, planted = Counter(), 0
    for _ in range(20):  # full sequences of 3 to 5 long pieces: largest-first takes 3 % more
        rest = 0
        while not 300 <= rest <= 900:
            some = [g.randint(300, 900) for _ in range(g.choice((2, 3, 3, 4)))]
            rest = 2048 - sum(some)
        times = g.randint(1, 1000)
        planted += times
        for x in [*some, rest]:
            counts[x] += times
    done = packing.plan(counts, 2048)
    assert Counter({x: sum(p.get(x, 0) * t for p, t in done) for x in counts}) == counts
    assert all(sum(x * k for x, k in p.items()) <= 2048 for p, _ in done)
    assert planted <= packing.sequences(done) <= planted * 1.003
    assert packing.sequences(packing.fill(dict(counts), 2048)) > planted * 1.02


def test_packing_lp_covers_every_length():
    counts = {1500: 7, 1100: 500, 1030: 301, 700: 900, 410: 33}  # no filling is full
    uses, bound = packing.solve_lp(counts, 2048, [])
    for x, n in counts.items():
        assert sum(p.get(x, 0) * use for p, use in uses) >= n * (1 - 1e-6)
    assert bound <= sum(use for _, use in uses) <= bound * (1 + 2 * packing.TOLERANCE)
    assert packing.sequences(packing.plan(counts, 2048)) <= bound * 1.002 + len(counts)


@pytest.mark.parametrize("make", [
    lambda d: pii.find(d.drop("spans")), pii.redact, linededup.dedup_lines, minhash.classes, minhash.drop_near,
    substring.digest, quality.judge, quality.keep_good, lambda d: packing.pack(d, JSON),
    lambda d: bpe.digest(d, RANKS, public_tokenizers.PATTERN)])
def test_empty_table(empty, make):
    assert make(empty).collect() == []


def test_registered_sql_small(spark, sf_small, registered):
    import duckdb
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_small}/{t}.parquet'")
    for name, sql in queries.oracle_sql().items():
        got = registered[name](spark, sf_small)
        cur = con.execute(sql)
        cols = [c[0] for c in cur.description]
        same(got.select(*cols).collect(), cur.fetchall())
